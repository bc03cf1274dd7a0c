"""Column functions over texts and tokens; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"(\s|[\p{L}\p{N}_\p{M}]+|[^\s\p{L}\p{N}_\p{M}])"


def tokens(text: Column) -> Column:
    """Tokens that join to the text again: runs of letters, digits, marks and underscores, or one character."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def token_count(text: Column) -> Column:
    return F.coalesce(F.size(tokens(text)), F.lit(0)).cast("long")


def last_tokens(toks: Column, n: int) -> Column:
    """At most the last n tokens."""
    return F.slice(toks, F.greatest(F.size(toks) - n, F.lit(0)) + 1, F.lit(n))


def text_to_html(text: Column) -> Column:
    """Escaped text; a blank line becomes a paragraph, a line end a break."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(text, r"\r?\n\r?\n", "<p>"), r"\r?\n", "<br>")


def elapsed(event: Column, now: Column) -> Column:
    """How long ago an event was, in words. Halves round to even; tenths follow the binary value, as in Python."""
    s = now - event

    def tenths(x: Column) -> Column:
        # The exact decimal expansion of the double, rounded half to even, tells 0.25 from 0.35.
        return F.bround(x.cast("decimal(38,18)"), 1).cast("decimal(30,1)").cast("string")

    return (
        F.when(s < 1, "just now")
        .when(s < 60, F.concat(F.bround(s, 0).cast("long").cast("string"), F.lit(" second(s) ago")))
        .when(s < 3600, F.concat(F.bround(s / 60, 0).cast("long").cast("string"), F.lit(" minute(s) ago")))
        .when(s < 86400, F.concat(tenths(s / 3600), F.lit(" hour(s) ago")))
        .otherwise(F.concat(tenths(s / 86400), F.lit(" day(s) ago")))
    )


def scratchpad(answer: Column) -> Column:
    """The text of the last fenced block, or null."""
    found = F.regexp_extract(answer, r"(?s)^.*```(?:txt)?(.*)```.*$", 1)
    return F.when(F.regexp_like(answer, F.lit(r"(?s)^.*```(?:txt)?(.*)```.*$")), F.trim(found))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\r?\n\r?\n"), lambda p: F.length(F.trim(p)) > 0)


def cache_name(url: Column) -> Column:
    """File name under which a download is kept: a digest of the address and its last part."""
    return F.concat(F.md5(url.cast("binary")), F.lit("-"), F.regexp_extract(url, r"([^/]*)$", 1))


def fill(template: str, **cols: Column) -> Column:
    """A template whose $name parts are replaced by columns."""
    out = F.lit(template)
    for name, c in cols.items():
        out = F.replace(out, F.lit(f"${name}"), c)
    return out


def norm_tokens(toks: Column) -> Column:
    """Lower-case tokens without spaces; sentence-like marks are '.', and one at the end goes."""
    low = F.transform(F.filter(toks, lambda t: F.length(F.trim(t)) > 0), lambda t: F.when(F.lower(t).isin(",", "!", ";", "..", "...", "!!", "!!!"), ".").otherwise(F.lower(t)))
    return F.when(F.element_at(F.concat(F.array(F.lit("")), low), -1) == ".", F.slice(low, F.lit(1), F.size(low) - 1)).otherwise(low)


def punctuation(newline: bool = False, colon: bool = False) -> list[str]:
    """Tokens that end a sentence."""
    return [".", "!", "?", *(["\n"] if newline else []), *([":"] if colon else [])]


def token_at(toks: Column, offset: Column) -> Column:
    """Index of the token that holds the character at an offset from 0; -1 past the end."""
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(-1).alias("hit"))

    def step(s: Column, t: Column) -> Column:
        end = s["at"] + F.length(t)
        return F.struct((s["i"] + 1).alias("i"), end.alias("at"), F.when((s["hit"] < 0) & (offset >= s["at"]) & (offset < end), s["i"]).otherwise(s["hit"]).alias("hit"))

    return F.aggregate(toks, state, step)["hit"].cast("long")


def after_last_line(text: Column, ignored: int = 18) -> Column:
    """What follows the last line break, not counting breaks among the last `ignored` characters; the whole text without one."""
    head = F.substring(text, F.lit(1), F.greatest(F.length(text) - ignored, F.lit(0)))
    at = F.length(head) - F.length(F.substring_index(head, "\n", -1))
    return F.substring(text, at + 1, F.length(text))


def within_length(text: Column, most: int = 2048) -> Column:
    """text, or an error where it is as long as `most`."""
    return F.when(F.length(text) >= most, F.raise_error(F.lit(f"the input has {most} characters or more"))).otherwise(text)


def heading(role: Column, content: Column, event: Column, now: Column) -> Column:
    """A user's content below how long ago it was; other content as it is."""
    return F.when(role == "user", F.concat(F.lit("["), elapsed(event, now), F.lit("]\n"), content)).otherwise(content)


def fenced(text: Column) -> Column:
    """A scratchpad as a fenced block."""
    return F.concat(F.lit("```txt\n"), text, F.lit("\n```"))


def indented_json(fields: Column) -> Column:
    """A map of strings as JSON, three spaces deep, keys in order."""
    quoted = lambda s: F.substring(F.to_json(F.struct(s.alias("x"))), F.lit(6), F.length(F.to_json(F.struct(s.alias("x")))) - 6)
    rows = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(F.lit("   "), quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.concat(F.lit("{\n"), F.array_join(rows, ",\n"), F.lit("\n}"))


def tagged_time(t: Column) -> Column:
    """A time as tagged JSON, and back by from_tagged_time."""
    return F.concat(F.lit('{"__type__":"datetime","value":"'), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"}'))


def from_tagged_time(s: Column) -> Column:
    return F.to_timestamp(F.get_json_object(s, "$.value"))


def processed_values(answer: Column) -> Column:
    """A rewritten memory: the values below "processed", a line each; null for what is no JSON."""
    found = F.from_json(answer, "processed map<string,string>")["processed"]
    return F.array_join(F.map_values(found), "\n")


def processed_query(answer: Column) -> Column:
    """A rewritten query: the text below "processed"."""
    return F.get_json_object(answer, "$.processed")
