"""Names, paths, URLs and display text of document jobs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of derived files in the order in which each side looks for them.
SERVER_MARKERS = (
    ("crop-compare.pdf", "crop-compare"), ("dual-cut.pdf", "dual-cut"), ("mono-cut.pdf", "mono-cut"), ("compare.pdf", "compare"),
    ("dual.pdf", "dual"), ("mono.pdf", "mono"), ("cut.pdf", "origin-cut"),
)
CLIENT_MARKERS = (
    ("mono.pdf", "mono"), ("dual.pdf", "dual"), ("mono-cut.pdf", "mono-cut"), ("dual-cut.pdf", "dual-cut"),
    ("crop-compare.pdf", "crop-compare"), ("compare.pdf", "compare"), ("cut.pdf", "origin-cut"),
)
#: What an operation makes of a type, and which types it accepts.
AFTER_CROP = {"origin": "origin-cut", "mono": "mono-cut", "dual": "dual-cut"}
AFTER_CROP_COMPARE = {"origin": "crop-compare", "dual": "crop-compare", "dual-cut": "crop-compare"}
AFTER_COMPARE = {"origin": "compare", "dual": "compare"}
ACCEPTED = {"translate": ("origin",), "crop": ("origin", "mono", "dual"), "compare": ("origin", "dual"), "crop-compare": ("origin", "dual", "dual-cut")}
TERMINAL = {"crop-compare": "crop-compare", "compare": "compare"}
#: Parts of a key that make its value a secret.
SECRET_KEYS = "(?i)key|token|secret|password|auth"
LAYOUTS = (".LR_dual.pdf", ".TB_dual.pdf")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def leaf(path: Column) -> Column:
    """Behind the last slash or backslash, trimmed; a fixed name if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(path, r"^.*[/\\]", "")), F.lit("")), F.lit("translated.pdf"))


def base_name(path: Column) -> Column:
    """Leaf without a ``.pdf`` ending in any case; the leaf itself if that is all."""
    name = leaf(path)
    return F.coalesce(F.nullif(F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit("")), name)


def _first(name: Column, markers: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit("origin")
    for mark, kind in reversed(markers):
        out = F.when(name.contains(mark), kind).otherwise(out)
    return out


def server_type(path: Column) -> Column:
    """Type by marker, terminal ones first."""
    return _first(basename(path), SERVER_MARKERS)


def client_type(path: Column) -> Column:
    """Type by marker, plain ones first; differs where a name holds two markers."""
    return _first(path, CLIENT_MARKERS)


def lookup(key: Column, table: dict[str, str], default: Column | str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default) if isinstance(default, str) else default)


def after(path: Column, table: dict[str, str]) -> Column:
    return lookup(server_type(path), table, "unknown")


def operation_error(operation: Column, kind: Column) -> Column:
    """Key of the message for a (operation, type) that isn't allowed, else null."""
    out = F.lit(None).cast("string")
    for op, kinds in ACCEPTED.items():
        out = F.when((operation == op) & ~kind.isin(*kinds), f"operation-error-{op}").otherwise(out)
    for op, kind_of in TERMINAL.items():
        out = F.when((operation == op) & (kind == kind_of), f"operation-error-{op}-terminal").otherwise(out)
    return out


def operation_status(operation: Column, kind: Column) -> Column:
    """200, 409 for a terminal type or 400 for one that isn't supported; for compare operations only."""
    ok, done = F.lit(False), F.lit(False)
    for op, kind_of in TERMINAL.items():
        ok = ok | ((operation == op) & kind.isin(*ACCEPTED[op]))
        done = done | ((operation == op) & (kind == kind_of))
    return F.when(done, 409).when(ok, 200).otherwise(400)


def layout_mode(path: Column, fallback: Column) -> Column:
    name = basename(path)
    mode = F.upper(F.coalesce(F.nullif(fallback, F.lit("")), F.lit("TB")))
    return F.when(name.endswith(LAYOUTS[0]), "LR").when(name.endswith(LAYOUTS[1]), "TB").when(mode.isin("LR", "TB"), mode).otherwise("TB")


def _without_layout(path: Column) -> Column:
    return F.substring(path, F.lit(1), F.length(path) - len(LAYOUTS[0]))


def derived_name(path: Column, out_type: Column, engine: Column) -> Column:
    """Name of a product; engine 2 joins with a dot, all others with a dash. All occurrences change."""
    kind, dot = server_type(path), engine == 2
    joint = F.when(dot, ".").otherwise("-")
    tail = F.concat(out_type, F.lit(".pdf"))
    layout = (kind == "dual") & (path.endswith(LAYOUTS[0]) | path.endswith(LAYOUTS[1]))
    from_origin = F.replace(path, F.lit(".pdf"), F.concat(joint, F.when(out_type == "origin-cut", F.lit("cut.pdf")).otherwise(tail)))
    other = F.replace(path, F.concat(kind, F.lit(".pdf")), tail)
    return F.when(layout, F.concat(_without_layout(path), joint, tail)).when(kind == "origin", from_origin).otherwise(other)


def layout_variants(path: Column) -> Column:
    """The LR and the TB name of a dual file."""
    stem = F.when(path.rlike(r"\.(LR_dual|TB_dual|dual)\.pdf$"), F.regexp_replace(path, r"\.(LR_dual|TB_dual|dual)\.pdf$", "")).otherwise(
        F.regexp_replace(path, r"(?<=[^/.])\.[^./]*$", "")
    )
    return F.struct(F.concat(stem, F.lit(LAYOUTS[0])).alias("lr"), F.concat(stem, F.lit(LAYOUTS[1])).alias("tb"))


def canonical_dual(path: Column, mode: Column) -> Column:
    """The dual name that carries its layout."""
    tail = F.when(F.upper(mode) == "LR", LAYOUTS[0]).otherwise(LAYOUTS[1])
    return (
        F.when(path.endswith(LAYOUTS[0]) | path.endswith(LAYOUTS[1]), F.concat(_without_layout(path), tail))
        .when(path.endswith(".dual.pdf"), F.concat(F.regexp_replace(path, r"\.dual\.pdf$", ""), tail))
        .otherwise(F.concat(F.regexp_replace(path, r"\.pdf$", ""), tail))
    )


def short_error(message: Column) -> Column:
    compact = F.trim(F.regexp_replace(message, r"\s+", " "))
    return F.when(F.length(compact) <= 80, compact).otherwise(F.concat(F.substring(compact, 1, 77), F.lit("...")))


def shown_map(values: Column) -> Column:
    """``k=v`` pairs in key order, long values and the whole cut short; keys of blanks go."""
    kept = F.filter(F.array_sort(F.map_entries(values)), lambda e: F.trim(e["key"]) != "")
    pair = lambda e: F.concat(e["key"], F.lit("="), _cut(F.coalesce(e["value"], F.lit("")), 10, 10))
    return _cut(F.array_join(F.transform(kept, pair), ", "), 50, 47)


def _cut(text: Column, most: int, keep: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def masked(key: Column, value: Column) -> Column:
    """A secret's last four characters behind stars; short ones are stars alone."""
    hidden = F.when(F.length(value) > 4, F.concat(F.lit("********"), F.right(value, F.lit(4)))).otherwise(F.repeat(F.lit("*"), F.length(value)))
    return F.when(key.rlike(SECRET_KEYS), hidden).otherwise(value)


def masked_arguments(args: Column) -> Column:
    """Stars in place of each argument that follows a secret's flag."""
    before = lambda i: F.get(args, i - 1)
    secret = lambda i: (i > 0) & before(i).rlike("(?i)key|token|secret|password")
    return F.transform(args, lambda x, i: F.when(secret(i), F.lit("***")).otherwise(x))


def upload_error(name: Column) -> Column:
    """Why an upload's name is refused, else null."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (
        F.when(n == "", "empty").when(n.isin(".", ".."), "dots").when(n.contains("/") | n.contains("\\"), "separator")
        .when(~F.lower(n).endswith(".pdf"), "extension")
    )


def inside(base: Column, path: Column) -> Column:
    """Whether a path without dot segments stands below ``base`` or is it."""
    root = F.regexp_replace(base, "/+$", "")
    return ((path == root) | path.startswith(F.concat(root, F.lit("/")))) & ~path.rlike(r"(^|/)\.\.(/|$)")


def trimmed_url(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "/+$", "")


def percent_encoded(text: Column) -> Column:
    """As a URL component; ``- _ . ! ~ * ' ( )`` and alphanumerics stay."""
    out = F.url_encode(text)
    for code, sign in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def percent_decoded(text: Column) -> Column:
    """Decoded once; a plus sign stays one, and bad escapes give null."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def package_name(requirement: Column) -> Column:
    bare = F.regexp_extract(F.trim(requirement), r"^([^\s<>=!~\[@]*)", 1)
    return F.lower(F.regexp_replace(bare, "[-_.]+", "-"))


def package_name_compat(requirement: Column) -> Column:
    return F.lower(F.translate(F.split_part(requirement, F.lit("="), F.lit(1)), "_.", "--"))


def shown_proxy(url: Column) -> Column:
    """Scheme, host and port of a proxy; a fixed word if it can't be read."""
    m = lambda k: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@]*@)?([^/:@?#]+)(:[0-9]+)?(?:[/?#]|$)", k)
    return F.when(m(2) != "", F.concat(F.lower(m(1)), F.lit("://"), F.lower(m(2)), m(3))).otherwise("<configured>")


def expected_outputs(name: Column, lang: Column, engine: Column, flag: Column, no_mono: Column, no_dual: Column) -> Column:
    """File names that an engine leaves. ``flag``: layout kept (engine 1), no watermark (engine 2)."""
    stem = F.replace(basename(name), F.lit(".pdf"), F.lit(""))
    mark = F.when(engine == 2, F.when(flag, ".no_watermark.").otherwise(".")).otherwise(".")
    own = lambda kind: F.when((engine == 1) & ~flag, F.concat(stem, F.lit(f"-{kind}.pdf"))).otherwise(F.concat(stem, mark, lang, F.lit(f".{kind}.pdf")))
    hide = lambda x: (engine == 2) & x
    both = F.array(F.when(~hide(no_mono), own("mono")), F.when(~hide(no_dual), own("dual")))
    return F.filter(both, lambda x: x.isNotNull())


def arguments(fixed: list[Column], options: list[tuple[Column, list[Column]]]) -> Column:
    """Fixed arguments, then those of every option whose condition holds."""
    none = F.array().cast("array<string>")
    return F.concat(F.array(*fixed), *(F.when(F.coalesce(c, F.lit(False)), F.array(*a)).otherwise(none) for c, a in options))


def option_value(args: Column, flag: str) -> Column:
    """Value of the first ``flag value`` or ``flag=value``."""
    last = F.size(args) - 1
    hits = F.transform(args, lambda x, i: F.when((x == flag) & (i < last), F.get(args, i + 1)).when(x.startswith(f"{flag}="), F.substring(x, F.lit(len(flag) + 2), F.length(x))))
    return F.get(F.filter(hits, lambda x: x.isNotNull()), F.lit(0))


def without_option(args: Column, flag: str) -> Column:
    """Arguments without ``flag value`` and ``flag=value``; a value that reads like the flag isn't one itself."""
    eaten = F.aggregate(
        args, F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.struct(
            (~s["skip"] & (x == flag)).alias("skip"),
            F.when(s["skip"] | (x == flag) | x.startswith(f"{flag}="), s["out"]).otherwise(F.array_append(s["out"], x)).alias("out"),
        ),
    )
    return eaten["out"]


def progress_bar(percent: Column, length: int = 10) -> Column:
    full = F.floor(percent / 100 * length).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), length - full), F.lit("]"))


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.when(seconds >= 60, F.concat(F.floor(whole / 60).cast("string"), F.lit("分"), F.pmod(whole, F.lit(60)).cast("string"), F.lit("秒"))).otherwise(F.concat(whole.cast("string"), F.lit("秒")))


def attachment_title(short: Column, service: Column, kind: Column, path: Column) -> Column:
    """Short title, service and kind; the file's leaf where no service is known."""
    named = F.concat_ws("-", F.nullif(short, F.lit("")), service, kind)
    return F.when(F.coalesce(service, F.lit("")) == "", leaf(path)).otherwise(named)


def model_label(model: Column, service: Column) -> Column:
    fixed = F.when(service == "siliconflowfree", "siliconflowfree (free)").when(service == "bing", "Bing").when(service == "google", "Google")
    return F.coalesce(F.nullif(model, F.lit("")), fixed, F.concat(service, F.lit(" (default)")))


def chosen_outputs(flags: dict[str, Column]) -> Column:
    return F.filter(F.array(*(F.when(c, k) for k, c in flags.items())), lambda x: x.isNotNull())


def first_error_line(log: Column, words: str = "错误|Error|Exception") -> Column:
    return F.get(F.filter(F.split(log, "\n"), lambda x: x.rlike(words)), F.lit(0))


def value_error(trace: Column) -> Column:
    """The last ValueError's text and the indented or caret lines after it, on one line; null if there is none."""
    hits = F.regexp_extract_all(trace, F.lit(r"(?m)^ValueError:[ \t]*(.*(?:\n(?:[ \t]|\^).*)*)"), 1)
    text = F.array_join(F.filter(F.transform(F.split(F.element_at(hits, -1), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), " ")
    return F.when(F.size(hits) > 0, F.nullif(text, F.lit("")))


def error_summary(trace: Column, fallback: Column) -> Column:
    """The ValueError, else the last line with text that doesn't begin with ``Traceback`` or ``File ``, else the error's class name.

    A line keeps its indentation, so an indented ``File`` line counts.
    """
    lines = F.transform(F.split(F.coalesce(trace, F.lit("")), r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("Traceback") & ~x.startswith("File "))
    return F.coalesce(value_error(trace), F.when(F.size(lines) > 0, F.element_at(lines, -1)), fallback)


def badge_url(label: Column, message: Column) -> Column:
    """A shield with encoded label and message; a known word decides colour and logo."""
    known = lambda word: message.contains(word)
    colour = F.when(known("GitHub"), "2d5a27").when(known("Bilibili"), "fb7299").otherwise("4c1")
    logo = F.when(known("GitHub"), "&logo=github").when(known("Bilibili"), "&logo=bilibili").otherwise("")
    return F.concat(F.lit("https://img.shields.io/static/v1?label="), percent_encoded(label), F.lit("&message="), percent_encoded(message), F.lit("&color="), colour, logo)


def model_list_request(service: Column, base: Column, key: Column) -> Column:
    """URL and way of signing for a service's list of models; null where a key or base is missing."""
    # Addresses of services that have one of their own.
    known = {
        "openailiked": "https://ark.cn-beijing.volces.com/api/v3", "AliyunDashScope": "https://dashscope.aliyuncs.com/compatible-mode/v1", "silicon": "https://api.siliconflow.cn/v1",
        "zhipu": "https://api.zhipu.com/v1", "modelscope": "https://api.modelscope.com/v1", "tencent": "https://tencent.com", "xinference": "http://127.0.0.1:9997",
    }
    addresses = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    url = trimmed_url(F.coalesce(F.nullif(base, F.lit("")), F.try_element_at(addresses, service)))
    has_key, keyed = F.coalesce(key, F.lit("")) != "", service.isin("deepseek", "openai", "gemini")
    # Public end points used where no base is given.
    base_or = lambda x: F.coalesce(F.nullif(url, F.lit("")), F.lit(x))
    own = F.when(url.endswith("/models"), url).when(F.coalesce(url, F.lit("")) != "", F.concat(url, F.lit("/models")))
    target = (
        F.when(keyed & ~has_key, F.lit(None).cast("string")).when(service == "deepseek", "https://api.deepseek.com/models")
        .when(service == "openai", F.concat(base_or("https://api.openai.com/v1"), F.lit("/models")))
        .when(service == "gemini", F.concat(base_or("https://generativelanguage.googleapis.com/v1beta"), F.lit("/models?key="), percent_encoded(key)))
        .when(service == "ollama", F.concat(base_or("http://localhost:11434"), F.lit("/api/tags"))).otherwise(own)
    )
    auth = F.when(service.isin("gemini", "ollama") | ~has_key, "none").otherwise("bearer")
    return F.struct(target.alias("url"), F.when(target.isNotNull(), auth).alias("auth"))


def localised(table: Column, prefix: str, key: Column) -> Column:
    """The text of a prefixed key in a map, else the key itself."""
    return F.coalesce(F.try_element_at(table, F.concat(F.lit(prefix), key)), key)
