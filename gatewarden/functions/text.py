"""Column functions on strings: URLs, query strings, percent escapes, tokens, signatures. Everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what separates words, besides white space.
WORD_SEPARATORS = r"[,;+/=&':?\s]+"
#: Superscripts and other characters that count as digits without being decimal digits.
OTHER_DIGITS = "²³¹⁰⁴-⁹₀-₉①-⑨"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def text(c: Column) -> Column:
    """Nulls as empty strings."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def unquote_plus(c: Column) -> Column:
    """Plus signs to spaces, percent escapes to UTF-8; malformed escapes stay as they are."""
    safe = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.rlike("[%+]"), F.try_url_decode(safe)).otherwise(c)


def unquote_fully(c: Column, rounds: int = 8) -> Column:
    """``unquote_plus`` until nothing changes; deeper nesting than ``rounds`` stays encoded."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), c, lambda s, _: unquote_plus(s))


def url_parts(url: Column) -> Column:
    """Lenient split of a URL: scheme, netloc, path, params, query, fragment; never fails, missing parts are empty.

    Parameters after a semicolon are cut off the last path segment only.
    """
    whole = text(url)
    cut = lambda g: F.regexp_extract(whole, r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", g)
    part = lambda p, g: F.regexp_extract(p, r"(?s)^((?:.*/)?[^;/]*)(?:;([^/]*))?$", g)
    path = cut(3)
    has = path.rlike(r"(?s);[^/]*$")
    return F.struct(
        F.lower(cut(1)).alias("scheme"),
        cut(2).alias("netloc"),
        F.when(has, part(path, 1)).otherwise(path).alias("path"),
        F.when(has, part(path, 2)).otherwise("").alias("params"),
        cut(4).alias("query"),
        cut(5).alias("fragment"),
    )


def query_pairs(query: Column) -> Column:
    """Array of (key, value) of a query string, decoded; pieces without a value are left out."""
    piece = lambda x: F.struct(
        unquote_plus(F.substring_index(x, "=", 1)).alias("key"),
        unquote_plus(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)).alias("value"),
        F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1).alias("raw"),
    )
    found = F.filter(F.transform(F.split(text(query), "&"), piece), lambda p: p["raw"] != "")
    return F.transform(found, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))


def query_map_keys(query: Column) -> Column:
    """Sorted distinct keys of a query string."""
    return F.array_sort(F.array_distinct(F.transform(query_pairs(query), lambda p: p["key"])))


def first_pairs(pairs: Column) -> Column:
    """Of pairs with equal keys, the first."""
    keys = F.transform(pairs, lambda p: p["key"])
    return let(keys, lambda k: F.filter(pairs, lambda p, i: F.array_position(k, p["key"]) == i + 1))


def prompt(method: Column, url: Column, body: Column) -> Column:
    return F.concat(F.lit("Method: "), text(method), F.lit(" URL: "), text(url), F.lit(" Body: "), text(body))


def raw_request(method: Column, url: Column, body: Column) -> Column:
    """Method and URL on a line, the body on the next."""
    return strip(F.concat(text(method), F.lit(" "), text(url), F.lit("\n"), text(body)))


def request_lines(method: Column, url: Column, body: Column) -> Column:
    """A line for each part that isn't empty."""
    line = lambda name, c: F.when(text(c) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", line("Method", method), line("URL", url), line("Body", body))


def request_content(url: Column, body: Column, kind: str = "all") -> Column:
    """URL and body (or one of them) with a space between, stripped."""
    url, body = (F.lit("") if kind == "body" else text(url)), (F.lit("") if kind == "url" else text(body))
    return strip(F.concat(url, F.lit(" "), body))


def parse_head(header: Column) -> Column:
    """Method and URL: the first two words of a request line."""
    words = F.split(strip(text(header)), r"(?U)\s+")
    return F.struct(F.get(words, 0).alias("method"), F.get(words, 1).alias("url"))


def word_tokens(c: Column) -> Column:
    """Decoded, split at separators; empty tokens are left out."""
    return F.filter(F.split(unquote_plus(text(c)), WORD_SEPARATORS), lambda x: x != "")


def characters(c: Column) -> Column:
    return F.filter(F.split(text(c), ""), lambda x: x != "")


def is_form(body: Column) -> Column:
    return text(body).rlike(r"(?U)^[\w.%+]+=")


def is_multipart(body: Column) -> Column:
    return text(body).startswith("-" * 29)


def not_blank(parts: Column) -> Column:
    return F.filter(parts, lambda x: strip(x) != "")


def http_parts(method: Column, url: Column, body: Column, whole_path: bool = False, headers: Column | None = None) -> Column:
    """Method, path (by segment or as a whole), query parts, header lines and body parts, blank ones left out."""
    split = url_parts(url)

    def of(u: Column) -> Column:
        segments = F.filter(F.split(u["path"], "/"), lambda x: x != "")
        path = F.array(u["path"]) if whole_path else F.transform(segments, lambda x: F.concat(F.lit("/"), x))
        form = F.when(is_form(body), F.split(text(body), "&")).otherwise(F.array(text(body)))
        lines = F.array().cast("array<string>") if headers is None else F.split(text(headers), "\n")
        return not_blank(F.concat(F.array(text(method)), path, F.split(u["query"], "&"), lines, form))

    return let(split, of)


def aligned(parts: Column, tokenizer: Callable[[Column], Column] = characters, decode: Callable[[Column], Column] = unquote_plus) -> Column:
    """Each part decoded, with its tokens."""
    return F.transform(parts, lambda p: F.struct(decode(p).alias("part"), tokenizer(decode(p)).alias("tokens")))


def all_tokens(alignment: Column) -> Column:
    return F.flatten(F.transform(alignment, lambda a: a["tokens"]))


def custom_body(body: Column) -> Column:
    """Parts of a body in braces, split at commas and trimmed; any other body is one part."""
    whole = strip(text(body))
    inner = F.split(strip(F.regexp_extract(whole, r"(?s)^\{(.*)\}$", 1)), ",")
    return F.when(whole.rlike(r"(?s)^\{.*\}$"), F.transform(inner, strip)).otherwise(F.array(whole))


def clean_string(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x1F\x7F]", "")


def clean_line(c: Column) -> Column:
    """Double quotes to spaces, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(c, '"', " "), r"(?U)\s+", " "))


def value_shape(c: Column) -> Column:
    """Letters to A, digits to N, all else to S."""
    letters = F.regexp_replace(text(c), r"\p{L}", "A")
    return F.regexp_replace(F.regexp_replace(letters, rf"[\p{{Nd}}{OTHER_DIGITS}]", "N"), r"(?s)[^AN]", "S")


def shape_codes(c: Column) -> Column:
    """Code points of a value's shape."""
    return F.transform(characters(value_shape(c)), F.ascii)


def encode_identifier(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("__PIPE__")), F.lit("/"), F.lit("__SLASH__"))


def decode_identifier(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("__PIPE__"), F.lit("|")), F.lit("__SLASH__"), F.lit("/"))


def regex_escape(c: Column) -> Column:
    """Backslashes before what has a meaning in patterns; wildcards stay."""
    escaped = F.regexp_replace(c, r"([\s#$&()*+\-.?\[\\\]^{|}~])", r"\\$1")
    return F.replace(escaped, F.lit(r"\.\*"), F.lit(".*"))


def signature_of(common: Column) -> Column:
    """A pattern from what the members of a cluster have in common; null if it would say nothing."""
    cleaned = clean_line(F.regexp_replace(common, r"\\+$", ""))
    pattern = regex_escape(F.regexp_replace(cleaned, r"(?U)\s+", ".*"))
    pattern = F.when(~pattern.isin("", "/", ".*"), pattern)
    return F.regexp_replace(pattern, "%[0-9a-fA-F]{2}", ".*")


def signature_length(signature: Column) -> Column:
    """Without wildcards."""
    return F.length(F.replace(signature, F.lit(".*"), F.lit("")))


def after_last(c: Column, marker: str) -> Column:
    """What follows the last marker, stripped; all of it without one."""
    return strip(F.substring_index(text(c), marker, -1))


def split_prompt(c: Column, marker: str = "# Input request") -> Column:
    """System part before the marker, user part from it on; without one, all is the user's."""
    at = F.instr(text(c), marker)
    return F.struct(
        F.when(at > 0, F.substr(text(c), F.lit(1), at - 1)).otherwise("").alias("system"),
        F.when(at > 0, F.substr(text(c), at)).otherwise(text(c)).alias("user"),
    )


def filled(template: Column, **values: Column) -> Column:
    """A template with its {names} filled."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), text(value))
    return template


#: The labels in the order of their ids, and short forms by which some are known.
LABELS = ("normal", "SQL Injection", "Forced Browsing", "Path Traversal", "Cross-site Scripting", "XML Injection", "OS Command Injection", "LDAP Injection", "Remote Code Execution", "Others")
SHORT_FORMS = {"Path Traversal": "traversal", "Cross-site Scripting": "xss", "XML Injection": "xxe", "Remote Code Execution": "rce"}
UNPARSED = len(LABELS)


def label_id(answer: Column, strict: bool = False) -> Column:
    """The first label named in an answer's conclusion, UNPARSED if none. With ``strict``, names count as words only."""
    low = F.lower(text(answer))
    rest = lambda marker: F.substr(low, F.instr(low, marker) + len(marker))
    tail = F.when(F.instr(low, "final classification") > 0, rest("final classification"))
    tail = tail.when(F.instr(low, "final answer:") > 0, rest("final answer:")).otherwise(low)

    def named(t: Column) -> Column:
        out = F.lit(UNPARSED)
        for i, label in reversed(list(enumerate(LABELS))):
            names = {SHORT_FORMS.get(label, label).lower(), label.lower()}
            fits = [t.rlike(rf"\b{n}\b") if strict else F.instr(t, n) > 0 for n in sorted(names)]
            out = F.when(fits[0] | fits[-1], F.lit(i)).otherwise(out)
        return out

    return let(tail, named)


def label_name(number: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in LABELS]), number), F.lit("unknown"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def lag_of(high: Column, committed: Column) -> Column:
    """Messages behind: none if nothing was committed yet."""
    return F.when(committed >= 0, F.greatest(F.lit(0), high - committed - 1)).otherwise(F.lit(0))


def iso_now() -> Column:
    """The query's start as an ISO time stamp without a zone, microseconds included."""
    return iso(F.localtimestamp())


def iso(time: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") -> Column:
    """A time as text: in ISO form, or by a pattern."""
    return F.date_format(time, pattern)


def row_hash(*columns: Column, separator: str = "\x1f") -> Column:
    return F.sha2(F.concat_ws(separator, *[text(c.cast("string")) for c in columns]), 256)


def is_parameter_name(c: Column) -> Column:
    return text(c).rlike(r"^[a-zA-Z0-9_.-]+$")


def canonical_url(url: Column, host: str = "") -> Column:
    """A path with a host before it and a slash between, escapes in upper case, the query sorted by its pieces, without
    the fragment."""
    whole = text(url)
    rooted = F.when(whole.startswith("/"), whole).otherwise(F.concat(F.lit("/"), whole)) if host else whole
    placed = F.concat(F.lit(host.rstrip("/")), rooted)

    def of(u: Column) -> Column:
        query = F.array_join(F.array_sort(F.filter(F.split(u["query"], "&"), lambda x: x != "")), "&")
        scheme = F.when(u["scheme"] != "", F.concat(u["scheme"], F.lit(":"))).otherwise("")
        netloc = F.when(u["netloc"] != "", F.concat(F.lit("//"), F.lower(u["netloc"]))).otherwise("")
        params = F.when(u["params"] != "", F.concat(F.lit(";"), u["params"])).otherwise("")
        tail = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
        path = F.when((u["path"] == "") & (u["netloc"] != ""), "/").otherwise(u["path"])
        return F.replace(F.concat(scheme, netloc, path, params, tail), F.lit(" "), F.lit("%20"))

    return let(url_parts(placed), lambda u: let(of(u), escapes_upper))


def escapes_upper(c: Column) -> Column:
    """Hexadecimal digits of percent escapes in upper case."""
    parts = F.split(c, "%", -1)
    up = lambda p: F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), F.substr(p, F.lit(3)))).otherwise(p)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(up(p))), "%")
