"""Text functions of entries and drafts, as column expressions with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that carry no signal in short phrases.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "have", "he", "her", "his", "i", "in", "is", "it", "its",
    "of", "on", "or", "she", "that", "the", "their", "they", "this",
    "to", "was", "we", "were", "will", "with",
)
LEAD_LINES, LEAD_CHARS = 6, 400
COVERS_HEADINGS, COVERS_SENTENCES, COVERS_CHARS, TAGS_MOST = 10, 5, 120, 8
CONFIDENT = 0.6


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def tokenize(c: Column) -> Column:
    """Lower-case runs of letters and digits of two characters or more, without stopwords."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def entry_text(focus: Column, *lists: Column) -> Column:
    """The compared text of an entry: focus twice, then every list; null and empty elements left out."""
    full = [F.array_join(F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda e: e.isNotNull() & (e != "")), " ") for x in lists]
    return strip(F.concat_ws(" ", focus, focus, *(F.nullif(x, F.lit("")) for x in full)))


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def pair_key(a: Column, b: Column) -> Column:
    """The same key for a pair of hashes in either order."""
    return F.substring(F.sha2(F.concat_ws("\u0000", F.least(a, b), F.greatest(a, b)), 256), 1, 32)


def base_name(path: Column) -> Column:
    """The last segment of a path without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*\z", "")


def slug_id(path: Column) -> Column:
    """The id of a source file: its base name as a slug; ``untitled`` or ``overview`` where that can't be."""
    s = F.regexp_replace(F.lower(base_name(path)), r"[^a-z0-9-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"-+", "-"), r"^-|-\z", "")
    return F.when(s == "", "untitled").when(s == "index", "overview").otherwise(s)


def title(raw: Column, path: Column) -> Column:
    """The first heading of level one, else the base name."""
    found = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?md)^#[ \t]+(\S[^\n]*?)[ \t]*$", 1)
    return F.coalesce(F.nullif(strip(found), F.lit("")), base_name(path))


def headings(raw: Column) -> Column:
    """level and text of every heading line."""
    raw = F.coalesce(raw, F.lit(""))
    pattern = F.lit(r"(?md)^(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*$")
    both = F.arrays_zip(F.regexp_extract_all(raw, pattern, F.lit(1)).alias("m"), F.regexp_extract_all(raw, pattern, F.lit(2)).alias("t"))
    return F.transform(both, lambda x: F.struct(F.length(x["m"]).alias("level"), strip(x["t"]).alias("text")))


def lead(raw: Column) -> Column:
    """The first paragraph that is neither heading nor fenced code: six lines and 400 characters at most.

    A fold over the lines: what is open (code, done) and the lines taken so far.
    """
    lines = F.split(F.coalesce(raw, F.lit("")), "\n")
    start = F.struct(F.lit(False).alias("code"), F.lit(False).alias("titled"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("taken"))

    def step(s: Column, line: Column) -> Column:
        fence = line.startswith("```")
        head = line.rlike(r"^#{1,6}\s+")
        blank = strip(line) == ""
        some = F.size(s["taken"]) > 0
        skip = s["done"] | fence | s["code"]
        take = ~skip & ~head & ~blank
        taken = F.when(take, F.concat(s["taken"], F.array(strip(line)))).otherwise(s["taken"])
        ends = ~skip & ((head & s["titled"] & some) | (~head & blank & some))
        return F.struct(
            (s["code"] != (fence & ~s["done"])).alias("code"),
            (s["titled"] | (~skip & head)).alias("titled"),
            (s["done"] | ends | (F.size(taken) >= LEAD_LINES)).alias("done"),
            taken.alias("taken"),
        )

    return F.substring(F.array_join(F.aggregate(lines, start, step)["taken"], " "), 1, LEAD_CHARS)


def covers(heads: Column, lead_text: Column) -> Column:
    """Headings of level two, else the sentences of the lead."""
    second = F.slice(F.transform(F.filter(heads, lambda h: h["level"] == 2), lambda h: h["text"]), 1, COVERS_HEADINGS)
    sentences = F.filter(F.split(lead_text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 10)
    return F.when(F.size(second) > 0, second).otherwise(F.slice(F.transform(sentences, lambda s: F.substring(s, 1, COVERS_CHARS)), 1, COVERS_SENTENCES))


def directory_tags(path: Column) -> Column:
    """The directories of a path as tags, and ``markdown`` for such a file."""
    parts = F.split(path, r"[/\\]")
    dirs = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: (p != "") & (p != ".") & ~p.rlike(r"^\d+\z"))
    slugs = F.transform(dirs, lambda p: F.regexp_replace(F.lower(p), r"[^a-z0-9-]+", "-"))
    mark = F.when(path.endswith(".md"), F.array(F.lit("markdown"))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(slugs, mark)), 1, TAGS_MOST)


def category(path: Column) -> Column:
    """The first directory as a slug, empty at the root."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: p != "")
    return F.when(F.size(parts) <= 1, "").otherwise(F.regexp_replace(F.lower(F.element_at(parts, 1)), r"[^a-z0-9-]+", "-"))


def confidence(focus: Column, id_: Column, cover: Column, heads: Column, size: Column) -> Column:
    """How sure a draft is, from 0 to 1."""
    n = F.size(cover)
    score = F.when((focus != "") & (focus != id_), 0.3).otherwise(0.0) + F.when(n >= 3, 0.4).when(n >= 1, 0.2).otherwise(0.0)
    score = score + F.when(F.size(F.filter(heads, lambda h: h["level"] == 2)) >= 2, 0.2).otherwise(0.0) + F.when(size > 200, 0.1).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 1)


def authored(value: Column, fallback: Column, is_list: bool = False) -> Column:
    """The authored value unless it is null, blank or an empty list."""
    empty = (F.size(value) == 0) if is_list else (strip(value) == "")
    return F.when(value.isNull() | empty, fallback).otherwise(value)


def valid_slug(c: Column) -> Column:
    return c.rlike(r"^[a-z][a-z0-9-]{0,63}\z")


def clamp01(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def jaccard(a: Column, b: Column) -> Column:
    """Common over all values of two lists taken as sets; two empty sets are unlike."""
    none = F.array().cast("array<string>")
    a, b = F.array_compact(F.coalesce(a, none)), F.array_compact(F.coalesce(b, none))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def fnv1a(c: Column) -> Column:
    """FNV-1a of 32 bits over the characters, as eight hex digits."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, x: (a.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.lpad(F.hex(F.when(F.length(c) == 0, F.lit(2166136261).cast("long")).otherwise(h)), 8, "0"))


def titleize(c: Column) -> Column:
    """A slug as a title: hyphens become blanks, words begin with capitals."""
    return F.initcap(F.regexp_replace(c, "-", " "))


def relative_path(from_dir: Column, to_dir: Column) -> Column:
    """The POSIX path from one directory to another; empty for the same."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    a, b = parts(from_dir), parts(to_dir)
    same = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")),
    )["n"]
    return F.concat_ws("/", F.array_repeat(F.lit(".."), F.size(a) - same), F.slice(b, same + 1, F.size(b)))


def authored_zone(body: Column, begin: str = "<!-- BEGIN AUTHORED ORIENTATION -->", end: str = "<!-- END AUTHORED ORIENTATION -->") -> Column:
    """The text between two comment marks."""
    q = lambda s: s.replace("(", "\\(")
    return F.regexp_extract(F.coalesce(body, F.lit("")), rf"(?s){q(begin)}(.*?){q(end)}", 1)


def leaf_signs(zone: Column) -> Column:
    """Whether a zone looks like a leaf: a code fence, a checklist or a numbered list."""
    fence = zone.rlike(r"(?md)^[ \t]*```")
    boxes = zone.rlike(r"(?md)^[ \t]*[-*][ \t]+\[[ xX]\]")
    return fence | boxes | (F.regexp_count(zone, F.lit(r"(?md)^[ \t]*\d+\.[ \t]+")) >= 2)


def redact_url(c: Column) -> Column:
    """A URL without its credentials."""
    return F.regexp_replace(c, r"(?i)^([a-z][a-z0-9+.-]*://)[^/@\s]+@", "$1***@")


def namespace(wiki: Column) -> Column:
    return F.regexp_replace(wiki, r"\.wiki\z", "")


# ---------------------------------------------------------------- DuckDB twins

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
STRIP = r"regexp_replace({0}, '^\s+|\s+\z', '', 'g')"
TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 2 AND NOT list_contains(" + _STOP + ", t))"
_LIST = "nullif(array_to_string(list_filter(coalesce({0}, []), lambda e: e IS NOT NULL AND e <> ''), ' '), '')"
ENTRY_TEXT = STRIP.format("concat_ws(' ', focus, focus, " + ", ".join(_LIST.format(c) for c in ("covers", "tags", "domains")) + ")")
BASE_NAME = r"regexp_replace(regexp_replace({0}, '^.*/', ''), '(.)\.[^.]*\z', '\1')"
_SLUG = r"regexp_replace(regexp_replace(regexp_replace(lower(" + BASE_NAME + r"), '[^a-z0-9-]+', '-', 'g'), '-+', '-', 'g'), '^-|-\z', '', 'g')"
SLUG_ID = "CASE " + _SLUG + " WHEN '' THEN 'untitled' WHEN 'index' THEN 'overview' ELSE " + _SLUG + " END"
TITLE = r"coalesce(nullif(" + STRIP.replace("{0}", r"regexp_extract(coalesce({0}, ''), '(?m)^#[ \t]+(\S[^\n]*?)[ \t]*$', 1)") + r", ''), " + BASE_NAME.replace("{0}", "{1}") + ")"
_HEAD = r"regexp_extract_all(coalesce({0}, ''), '(?m)^(#{{1,6}})[ \t]+(\S[^\n]*?)[ \t]*$', "
HEADINGS = "list_transform(list_zip(" + _HEAD + "1), " + _HEAD + "2)), lambda x: {{'level': length(x[1])::INTEGER, 'text': " + STRIP.replace("{0}", "x[2]") + "}})"
JACCARD = "CASE WHEN len(list_distinct(list_concat(coalesce({0}, []), coalesce({1}, [])))) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(coalesce({0}, [])), list_distinct(coalesce({1}, [])))) / len(list_distinct(list_concat(coalesce({0}, []), coalesce({1}, [])))) END"
