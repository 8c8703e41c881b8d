"""Typed parsing of loosely typed requests: booleans, integers, defaults, decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that each side takes for true or false.
PROTOCOL_TRUE = ("1", "true", "yes", "async", "accepted")
CLI_TRUE, CLI_FALSE = ("yes", "true", "t", "1", "y"), ("no", "false", "f", "0", "n")
EXTRA_TRUE, EXTRA_FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")
BOOL_SUFFIXES = ("_enable_json_mode", "_send_temprature", "_send_temperature", "_send_reasoning_effort", "_enable_thinking", "_send_enable_thinking_param")
THINKING, EFFORT, MODEL_PREFIX = "deepseek_thinking_mode", "deepseek_reasoning_effort", "deepseek-v4-"
PDF_HEAD, PDF_TAIL = bytearray(b"%PDF-"), bytearray(b"%%EOF")


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def request_bool(text: Column) -> Column:
    """``true`` and ``True`` alone; neither ``TRUE`` nor ``1`` as text."""
    return F.coalesce(text.isin("true", "True"), F.lit(False))


def protocol_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*PROTOCOL_TRUE), F.lit(False))


def cli_bool(text: Column) -> Column:
    """True, false, or null for a word that is neither."""
    return F.when(F.lower(text).isin(*CLI_TRUE), True).when(F.lower(text).isin(*CLI_FALSE), False)


def client_bool(text: Column) -> Column:
    return F.coalesce(text.isin("true", "1", "True", "TRUE"), F.lit(False))


def wants_async(header: Column, body: Column, protocol: Column) -> Column:
    """A true header wins; else a body flag decides if present; else the protocol's word."""
    return F.when(protocol_bool(header), True).when(body.isNotNull(), protocol_bool(body)).otherwise(protocol_bool(protocol))


def whole_number(text: Column, default: int) -> Column:
    """An integer with optional blanks, sign and single underscores, else the default."""
    plain = F.trim(text)
    return F.coalesce(F.when(plain.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(plain, F.lit("_"), F.lit("")).try_cast("int")), F.lit(default))


def skip_pages(text: Column) -> Column:
    return F.greatest(whole_number(text, 0), F.lit(0))


def at_least_one(text: Column, default: int) -> Column:
    n = whole_number(text, default)
    return F.when(n < 1, default).otherwise(n)


def pool_size(text: Column) -> Column:
    return F.least(F.greatest(whole_number(text, 0), F.lit(0)), F.lit(1000))


def strict_number(text: Column) -> Column:
    """A double; bad text is an error, not a default."""
    return F.trim(text).cast("double")


def text_or(text: Column, least: int, default: str) -> Column:
    """The text if it has ``least`` characters, else the default."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) >= least, text).otherwise(default)


def engine_service(engine: Column, service: Column, second: Column, engines: tuple[str, ...] = ("engine-1", "engine-2"), defaults: tuple[str, str] = ("bing", "siliconflowfree")) -> Column:
    """The service of a request: the second engine has a field of its own, which goes before the common one.

    An absent, blank or too short name is the engine's default.
    """
    first = text_or(service, 3, defaults[0])
    own = F.coalesce(F.nullif(second, F.lit("")), service)
    return F.when(engine_or(engine, engines) == engines[0], first).otherwise(text_or(own, 3, defaults[1]))


def engine_or(text: Column, known: tuple[str, ...]) -> Column:
    return F.when(text.isin(*known), text).otherwise(known[0])


def extra_value(key: Column, value: Column) -> Column:
    """(kind, bool, int, text): flags become booleans, one key an integer, all else stays."""
    flag = F.lit(False)
    for suffix in BOOL_SUFFIXES:
        flag = flag | key.endswith(suffix)
    word = F.lower(F.trim(value))
    truth = F.when(flag & word.isin(*EXTRA_TRUE), True).when(flag & word.isin(*EXTRA_FALSE), False)
    number = F.when((key == "num_predict") & F.trim(value).rlike("^[+-]?[0-9]+$"), F.trim(value).try_cast("int"))
    kind = F.when(truth.isNotNull(), "bool").when(number.isNotNull(), "int").otherwise("text")
    return F.struct(kind.alias("kind"), truth.alias("b"), number.alias("i"), F.when(kind == "text", value).alias("s"))


def empty_value(json: Column) -> Column:
    """Null, empty text, list or map as JSON; false and zero are values."""
    return F.coalesce(F.regexp_replace(json, r"\s", "").isin("null", '""', "[]", "{}"), F.lit(True))


def decoded_upload(data: Column) -> Column:
    """Bytes of base64 text after an optional data URL prefix; null unless well formed."""
    body = F.when(data.startswith("data:"), F.substring_index(data, ",", -1)).otherwise(data)
    body = F.regexp_replace(body, "[^A-Za-z0-9+/=]", "")
    return F.when(F.length(body) % 4 == 0, F.try_to_binary(body, F.lit("base64")))


def is_pdf(content: Column) -> Column:
    """A head mark in the first 1024 bytes and an end mark in the last 65536."""
    size = F.octet_length(content)
    head = F.substring(content, F.lit(1), F.lit(1024))
    tail = F.substring(content, F.greatest(size - 65535, F.lit(1)), F.lit(65536))
    return F.coalesce(F.contains(head, F.lit(PDF_HEAD)) & F.contains(tail, F.lit(PDF_TAIL)), F.lit(False))


def is_zip(content: Column) -> Column:
    """The two letters of an archive at the head, and the mark of its directory's end in the last 65557 bytes."""
    tail = F.substring(content, F.greatest(F.octet_length(content) - 65556, F.lit(1)), F.lit(65557))
    return F.coalesce(content.startswith(F.lit(b"PK")) & F.contains(tail, F.lit(b"PK\x05\x06")), F.lit(False))


def is_html(content_type: Column, content: Column) -> Column:
    head = F.lower(F.ltrim(F.substring(content, 1, 200)))
    return F.coalesce(F.lower(content_type).contains("text/html"), F.lit(False)) | head.startswith("<!doctype html") | head.startswith("<html")


def kept_strings(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def task_id(camel: Column, snake: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(camel, snake)), F.lit(""))


def effective_model(model: Column, configured: Column) -> Column:
    """The request's model, else the one in the stored configuration, trimmed; empty if there is none."""
    return F.trim(F.coalesce(F.nullif(model, F.lit("")), configured, F.lit("")))


def controlled_model(model: Column) -> Column:
    return F.coalesce(F.trim(model).startswith(MODEL_PREFIX), F.lit(False))


def thinking_mode(value: Column) -> Column:
    """enabled or disabled; nothing counts as disabled; another word is ``error``."""
    word = F.lower(F.trim(F.coalesce(F.nullif(value, F.lit("")), F.lit("disabled"))))
    return F.when(word.isin("", "null", "none"), "disabled").when(word.isin("enabled", "disabled"), word).otherwise("error")


def thinking_policy(value: Column, supported: Column) -> Column:
    mode = thinking_mode(value)
    return F.when(mode == "error", "error").when(supported, "pass-flags").when(mode == "enabled", "block").otherwise("strip-and-allow")


def controlled_extra(extra: Column, model: Column) -> Column:
    """Extra values with the controls made explicit for a controlled model, dropped for others; null on a bad word."""
    bare = F.map_filter(extra, lambda k, v: ~k.isin(THINKING, EFFORT))
    mode = thinking_mode(F.try_element_at(extra, F.lit(THINKING)))
    effort = F.lower(F.trim(F.coalesce(F.nullif(F.try_element_at(extra, F.lit(EFFORT)), F.lit("")), F.lit("high"))))
    on = F.map_concat(bare, F.create_map(F.lit(THINKING), F.lit("enabled"), F.lit(EFFORT), effort))
    off = F.map_concat(bare, F.create_map(F.lit(THINKING), F.lit("disabled")))
    chosen = F.when(mode == "disabled", off).when((mode == "enabled") & effort.isin("high", "max"), on)
    return F.when(controlled_model(model), chosen).otherwise(bare)


def renamed_key(values: Column, old: str, new: str) -> Column:
    """The old key's value under the new key unless that is there; the old key goes."""
    bare = F.map_filter(values, lambda k, v: k != old)
    moved = F.map_concat(bare, F.create_map(F.lit(new), F.try_element_at(values, F.lit(old))))
    return F.when(F.map_contains_key(values, old) & ~F.map_contains_key(values, new), moved).otherwise(bare)


def quiet_path(path: Column, prefixes: Column) -> Column:
    """Whether a path is one of the prefixes or below one."""
    return F.exists(prefixes, lambda p: (path == p) | path.startswith(F.concat(p, F.lit("/"))))


def saved_extra(extra: Column) -> Column:
    """What a form saves: no blank keys or values, and words out of range fall back instead of failing."""
    kept = F.map_filter(extra, lambda k, v: (F.trim(k) != "") & (k != "__custom__") & F.coalesce(v != "", F.lit(False)))
    mode = lambda v: F.when(v == "enabled", v).otherwise("disabled")
    effort = lambda v: F.when(v.isin("high", "max"), v).otherwise("high")
    return F.transform_values(kept, lambda k, v: F.when(k == THINKING, mode(v)).when(k == EFFORT, effort(v)).otherwise(v))


def widget_value(kind: Column, value: Column, domain: Column) -> Column:
    """Text of a form field: flags as words, choices within their domain, else empty."""
    flag = F.when(F.lower(value).isin("true", "false"), F.lower(value)).otherwise("")
    choice = F.when(F.array_contains(domain, value), value).otherwise("")
    return F.when(kind == "boolean", flag).when(kind == "enum", choice).otherwise(F.coalesce(value, F.lit("")))


def connection_failure(code: Column, status: Column, message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(text.contains("timeout") | text.contains("timed out"), "timeout")
        .when(status.isin(401, 403, 404) | (code == "bad-payload"), "wrong-service").when(status > 0, "status")
        .when(text.rlike("refused|network|unreachable|failed to fetch"), "unreachable").otherwise("other")
    )


def legacy_text(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def legacy_pages(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).otherwise(0)


def preferred_index(mirrors: Column, custom: Column, mirror: Column, default: str) -> Column:
    """The default index without mirrors; a custom mirror; none for the default mirror."""
    return F.when(~mirrors, default).when(~blank(custom), custom).when(mirror.isNotNull() & (mirror != ""), mirror)


def migrated_model(model: Column, aliases: dict[str, str]) -> Column:
    """A retired model's successor; an explicit other choice stays."""
    out = model
    for old, new in aliases.items():
        out = F.when(F.trim(model) == old, new).otherwise(out)
    return out
