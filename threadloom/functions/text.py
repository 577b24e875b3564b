"""Ids, message lines, links, commands and response parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

_SPACE = r"(?U)\s"
_INT = r"^[+-]?\d+(_\d+)*$"
_FLOAT = r"(?i)^[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*|\d+(_\d+)*\.)(e[+-]?\d+)?$"
_FLOAT_WORD = r"(?i)^[+-]?(inf|infinity|nan)$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


# --- ids ---------------------------------------------------------------------------


def compose_id(chat_id: Column, raw: Column) -> Column:
    return F.concat_ws("_", chat_id.cast("string"), raw.cast("string"))


def raw_id(msg_id: Column) -> Column:
    """The part after the first underscore; ids without one are already raw."""
    return F.when(F.instr(msg_id, "_") > 0, F.regexp_extract(msg_id, r"(?s)^[^_]*_(.*)$", 1)).otherwise(msg_id)


def to_bigint(c: Column) -> Column:
    plain = strip(c)
    return F.when(plain.rlike(_INT), F.regexp_replace(plain, "_", "").try_cast("bigint"))


def link_msg_id(msg_id: Column) -> Column:
    return to_bigint(raw_id(msg_id))


def render_msg_id(msg_id: Column) -> Column:
    return F.coalesce(link_msg_id(msg_id), F.pmod(F.xxhash64(msg_id), F.lit(10**9)))


# --- chunk text --------------------------------------------------------------------


def format_message(ts: Column, sender: Column, content: Column) -> Column:
    return F.format_string(
        "[date: %s] [user: %s] %s",
        F.date_format(ts, fixed.DATE_FORMAT),
        F.coalesce(sender, F.lit(fixed.UNKNOWN_SENDER)),
        F.coalesce(content, F.lit("")),
    )


def chunk_prefix(ts_from: Column, ts_to: Column, senders: Column) -> Column:
    return F.concat(
        F.lit("snippet: "),
        F.date_format(ts_from, fixed.DATE_FORMAT),
        F.lit("–"),
        F.date_format(ts_to, fixed.DATE_FORMAT),
        F.lit(". participants: "),
        F.array_join(F.array_sort(F.array_distinct(senders)), ", "),
        F.lit(".\n"),
    )


def token_count(text: Column) -> Column:
    """The documented fallback rule, four characters a token."""
    return F.floor(F.char_length(text) / 4).cast("int")


def clean_text(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def preview(text: Column, size: int = 200) -> Column:
    return F.concat(clean_text(F.substring(text, 1, size)), F.lit("..."))


def short_title(title: Column, size: int = 38) -> Column:
    named = F.when(F.coalesce(title, F.lit("")) == "", F.lit(fixed.UNNAMED_TITLE)).otherwise(title)
    return F.substring(named, 1, size)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


# --- metadata ----------------------------------------------------------------------


def meta_get(metadata: Column, key: str) -> Column:
    """A key of a metadata object; anything that is not a JSON object has no keys."""
    return F.when(F.ltrim(metadata).startswith("{"), F.get_json_object(metadata, f"$.{key}"))


# --- links and HTML ----------------------------------------------------------------


def message_link(chat_id: Column, msg_id: Column, username: Column) -> Column:
    cid, mid = chat_id.cast("bigint").cast("string"), msg_id.cast("string")
    internal = F.regexp_extract(cid, r"^-100(\d*)$", 1).try_cast("bigint").cast("string")
    return (
        F.when(F.length(strip(F.coalesce(username, F.lit("")))) > 0, F.concat(F.lit("https://t.me/"), username, F.lit("/"), mid))
        .when(cid.startswith("-100"), F.concat(F.lit("https://t.me/c/"), internal, F.lit("/"), mid))
        .when(cid.startswith("-"), F.concat(F.lit("tg://openmessage?chat_id="), cid, F.lit("&message_id="), mid))
        .otherwise(F.concat(F.lit("tg://openmessage?user_id="), cid, F.lit("&message_id="), mid))
    )


def escape_html(c: Column) -> Column:
    out = c
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def render_head(msg_id: Column, date: Column, sender: Column, sender_id: Column | None = None) -> Column:
    who = F.concat(F.lit("<code>sender: "), escape_html(sender))
    if sender_id is not None:
        known = F.coalesce(sender_id.cast("string"), F.lit("")) != ""
        who = F.concat(
            who, F.when(known, F.concat(F.lit(" (user_id: "), sender_id.cast("string"), F.lit(")"))).otherwise(F.lit(""))
        )
    return F.concat(
        F.lit("<code>id: "), msg_id.cast("string"), F.lit("</code>\n<code>date: "), date, F.lit("</code>\n"),
        who, F.lit("</code>\n"),
    )


def render_html(msg_id: Column, date: Column, sender: Column, text: Column, sender_id: Column | None = None) -> Column:
    return F.concat(
        render_head(msg_id, date, sender, sender_id), F.lit("<pre>"), escape_html(text), F.lit("</pre>")
    )


# --- commands ----------------------------------------------------------------------


def parse_search_args(text: Column, default_threshold: float = 1.5) -> Column:
    """``struct(threshold, query, error)``: an optional leading number, then the query."""
    rest = strip(F.when(text.startswith(fixed.FIND_COMMAND), F.substring(text, len(fixed.FIND_COMMAND) + 1, 2**31 - 1)).otherwise(text))
    first = F.regexp_extract(rest, r"(?U)^(\S+)", 1)
    tail = strip(F.regexp_replace(rest, r"(?U)^\S+", ""))
    numeric = first.rlike(_FLOAT) | first.rlike(_FLOAT_WORD)
    number = F.regexp_replace(F.regexp_replace(first, "_", ""), "(?i)^([+-]?)inf(inity)?$", "$1Infinity").try_cast("double")
    error = (
        F.when(rest == "", F.lit("usage"))
        .when(numeric & (tail == ""), F.lit("threshold_without_query"))
    )
    query = F.when(error.isNotNull(), F.lit(None).cast("string")).when(numeric, tail).otherwise(rest)
    threshold = F.when(error.isNotNull(), F.lit(None).cast("double")).when(numeric, number).otherwise(F.lit(default_threshold))
    return F.struct(threshold.alias("threshold"), query.alias("query"), error.alias("error"))


def has_mention(text: Column, entities: Column, username: str, account_id: int) -> Column:
    """Any entity span that spells ``@username`` or names the account itself."""
    def hit(e: Column) -> Column:
        span = F.lower(F.substring(text, e["offset"].cast("int") + F.lit(1), e["length"].cast("int")))
        by_name = (e["type"] == "mention") & (span == F.lit("@" + username.lower())) if username else F.lit(False)
        by_id = (e["type"] == "text_mention") & (e["user_id"] == F.lit(account_id))
        return F.coalesce(by_name | by_id, F.lit(False))

    return F.coalesce(F.exists(entities, hit), F.lit(False))


def search_mention(text: Column, mentioned: Column, username: str) -> Column:
    """The query of ``@username find ...``; null when the text is anything else."""
    body = strip(text)
    name = "@" + username.lower()
    after = F.regexp_replace(F.substring(body, len(name) + 1, 2**31 - 1), r"(?U)^\s+", "")
    word = F.lower(F.regexp_extract(after, r"(?U)^(\S+)", 1))
    rest = strip(F.regexp_replace(after, r"(?U)^\S+", ""))
    ok = (
        mentioned
        & ~text.startswith("/")
        & F.lower(body).startswith(name)
        & word.isin(*fixed.SEARCH_WORDS)
        & (rest != "")
    )
    return F.when(ok, rest)


# --- generated titles --------------------------------------------------------------


def needs_name(title: Column, level: str = "l1", mode: str = "only_unnamed") -> Column:
    """Topics the naming stage has to visit; ``rebuild`` and ``all`` visit every topic."""
    if mode != "only_unnamed":
        return F.lit(True)
    blank = F.coalesce(F.lower(strip(title)), F.lit("")).isin("", fixed.UNNAMED_TITLE)
    return blank | title.startswith(fixed.L1_PLACEHOLDER) if level == "l1" else blank


def is_named(title: Column, level: str = "l1") -> Column:
    """The audit's rule: it does not trim, and knows a placeholder for both levels."""
    prefix = fixed.L1_PLACEHOLDER if level == "l1" else fixed.L2_PLACEHOLDER
    plain = F.coalesce(title, F.lit(""))
    return ~F.lower(plain).isin("", fixed.UNNAMED_TITLE) & ~plain.startswith(prefix)


def parse_title_response(response: Column) -> Column:
    """``struct(title, description, status)``; status is ``ok`` or what the retry is for."""
    plain = strip(F.coalesce(response, F.lit("")))
    after_json = F.element_at(F.split(plain, "```json", 3), 2)
    after_any = F.element_at(F.split(plain, "```", 3), 2)
    body = strip(
        F.when(F.instr(plain, "```json") > 0, F.element_at(F.split(after_json, "```", 2), 1))
        .when(F.instr(plain, "```") > 0, after_any)
        .otherwise(plain)
    )
    parsed = F.try_parse_json(body)
    # the parser stops behind the first value; what may end both a list and an object is one value and no more
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).isNotNull() & F.try_parse_json(
        F.concat(F.lit('{"a":'), body, F.lit("}"))
    ).isNotNull()
    kind = F.schema_of_variant(parsed)
    is_object = kind.startswith("OBJECT")
    title = F.try_variant_get(parsed, "$.title", "string")
    description = F.try_variant_get(parsed, "$.description", "string")
    keys = F.from_json(body, "map<string,string>")
    has_keys = F.map_contains_key(keys, "title") & F.map_contains_key(keys, "description")
    status = (
        F.when(plain == "", F.lit("empty_response"))
        .when(parsed.isNull() | ~whole, F.lit("invalid_json"))
        .when(~is_object, F.lit("not_an_object"))
        .when(~F.coalesce(has_keys, F.lit(False)), F.lit("missing_key"))
        .when((strip(F.coalesce(title, F.lit(""))) == "") | (strip(F.coalesce(description, F.lit(""))) == ""), F.lit("empty_value"))
        .otherwise(F.lit("ok"))
    )
    ok = status == "ok"
    return F.struct(
        F.when(ok, title).alias("title"), F.when(ok, description).alias("description"), status.alias("status")
    )


# --- budgets and access ------------------------------------------------------------


def usage_percentage(tokens: Column, limit: int) -> Column:
    return F.round(tokens / F.lit(float(limit)) * 100, 2) if limit > 0 else F.lit(0.0)


def usage_band(percentage: Column) -> Column:
    return F.when(percentage > 80, F.lit("high")).when(percentage > 50, F.lit("medium")).otherwise(F.lit("low"))


def access_decision(is_private: Column, is_command: Column, command: Column, is_admin: Column, chat_allowed: Column) -> Column:
    """``struct(allowed, reason)`` from the flags of one incoming event."""
    public = is_command & (
        command.startswith(fixed.PUBLIC_COMMANDS[0]) | command.startswith(fixed.PUBLIC_COMMANDS[1])
    )
    reason = (
        F.when(F.coalesce(public, F.lit(False)) | is_admin, F.lit(None).cast("string"))
        .when(is_private, F.lit("private_non_admin"))
        .when(is_command | chat_allowed, F.lit(None).cast("string"))
        .otherwise(F.lit("chat_not_whitelisted"))
    )
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"))
