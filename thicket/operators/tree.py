"""The tree of directories: index rows, shared values, fanout, and the rewrites that reshape it.

Every rewrite derives new rows and leaves its input as it is; a new version of the corpus is what
``history`` writes from them. Index rows are rows, not arrays per directory, so a directory of any
size is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from thicket.functions.text import hashed, jaccard, relative_path, titleize
from thicket.plans.scale import cut
from thicket.sources.entries import LEAVES_SQL, PAGES_SQL, leaf_terms, leaves, pages

#: Target fanout of a directory and the factor beyond which it is overfull; greatest depth.
TARGET_FANOUT, OVERFULL, MAX_DEPTH = 20, 1.5, 2
#: Covers from which an entry should be decomposed (more than so many in the shape check); likeness that merges.
DECOMPOSE, MERGE_COVERS = 12, 0.7
#: Soft parents: least cosine and how many.
SOFT_LEAST, SOFT_MOST = 0.35, 3
#: Leaves of a block and most blocks that the leaves of a wiki are parted into; these spread the work and change no result.
SOFT_LEAVES, SOFT_PARTS = 20_000, 16
#: Leaves below the categories of a block, its pages, and products worked out at a time; these bound memory and change no result.
SOFT_BELOW, SOFT_PAGES, SOFT_WORK = 300_000, 100_000, 2_000_000


def directories(lv: DataFrame) -> DataFrame:
    """wiki_id, path, depth, leaves, subdirs of every directory that holds a leaf, and of all above it."""
    own = lv.groupBy("wiki_id", "parent_dir").agg(F.count("*").alias("leaves"))
    parts = F.split("parent_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    every = own.select("wiki_id", F.explode(above).alias("path")).distinct()
    up = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*\z", "")).otherwise("")
    subs = every.where("path <> ''").select("wiki_id", up.alias("path")).groupBy("wiki_id", "path").agg(F.count("*").alias("subdirs"))
    d = every.join(own.withColumnRenamed("parent_dir", "path"), ["wiki_id", "path"], "left").join(subs, ["wiki_id", "path"], "left").na.fill(0, ["leaves", "subdirs"])
    return d.withColumn("depth", F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))))


def index_entries(lv: DataFrame) -> DataFrame:
    """dir, id, file, type, focus: the rows of each derived index; a missing focus is the title of the id."""
    focus = F.coalesce(F.nullif("focus", F.lit("")), titleize(F.col("id")))
    return lv.select("dir", "id", F.substring_index("path", "/", -1).alias("file"), "type", focus.alias("focus"))


def rebuilt_index(lv: DataFrame, pg: DataFrame) -> DataFrame:
    """wiki_id, path, depth_role, entries, children, shared_covers of the index page of every directory.

    Entries are lines of id, file and type in order of the file, children the subdirectories; shared covers are those
    that all leaves of a directory (two at least) have, and those that its page already names. A page lists its
    directory, so a row is as large as the page that it describes.
    """
    d = directories(lv)
    line = F.struct(F.substring_index("path", "/", -1).alias("f"), F.concat_ws(" ", "id", F.substring_index("path", "/", -1), "type").alias("x"))
    own = lv.groupBy("wiki_id", F.col("parent_dir").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["x"]), "\n").alias("entries"))
    up = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*\z", "")).otherwise("")
    subs = d.where("path <> ''").select("wiki_id", up.alias("up"), F.substring_index("path", "/", -1).alias("c")).groupBy("wiki_id", F.col("up").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("c")), "\n").alias("children"))
    held = shared(lv.withColumn("dir", F.struct("wiki_id", F.col("parent_dir").alias("path"))), "covers").select("dir.*", "value")
    named = pg.select("wiki_id", F.col("parent_dir").alias("path"), F.explode("shared_covers").alias("value")).where("value IS NOT NULL")
    covers = held.unionByName(named).groupBy("wiki_id", "path").agg(F.array_join(F.array_sort(F.collect_set("value")), "\n").alias("shared_covers"))
    out = d
    for part in (own, subs, covers):
        out = out.join(part, ["wiki_id", "path"], "left")
    role = F.when(F.col("depth") == 0, "category").otherwise("subcategory")
    return out.select("wiki_id", "path", role.alias("depth_role"), "entries", "children", "shared_covers")


def children(pg: DataFrame) -> DataFrame:
    """dir, child, file: the index pages that lie one directory below each."""
    return pg.where("parent_dir <> ''").select(F.col("up").alias("dir"), F.col("id").alias("child"), F.concat(F.substring_index("parent_dir", "/", -1), F.lit("/index.md")).alias("file"))


def stubs(lv: DataFrame, pg: DataFrame) -> DataFrame:
    """wiki_id, path, depth_role: index rows to be made for directories without a page."""
    have = pg.select("wiki_id", F.col("parent_dir").alias("path"))
    role = F.when(F.col("depth") == 0, "category").otherwise("subcategory")
    return directories(lv).join(have, ["wiki_id", "path"], "left_anti").select("wiki_id", "path", role.alias("depth_role"))


def shared(lv: DataFrame, column: str, least: int = 2) -> DataFrame:
    """dir, value: values that every leaf of a directory of ``least`` leaves or more has."""
    n = lv.groupBy("dir").agg(F.count("*").alias("n"))
    held = lv.select("dir", "leaf_no", F.explode(F.array_distinct(F.coalesce(column, F.array().cast("array<string>")))).alias("value")).where("value IS NOT NULL")
    return held.groupBy("dir", "value").agg(F.count("*").alias("k")).join(n, "dir").where((F.col("k") == F.col("n")) & (F.col("n") >= least)).select("dir", "value")


def fanout(lv: DataFrame) -> DataFrame:
    """Every directory with its counts and whether it is overfull."""
    d = directories(lv)
    return d.select("wiki_id", "path", "leaves", "subdirs", (F.col("leaves") > OVERFULL * TARGET_FANOUT).alias("overfull"))


def fanout_stats(lv: DataFrame) -> DataFrame:
    d = directories(lv).withColumn("n", F.col("leaves") + F.col("subdirs"))
    return d.groupBy("wiki_id").agg(F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.max("depth").alias("depth"))


def passthroughs(lv: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Directories without leaves and with one subdirectory; those deeper than ``depth`` - 1 should be flattened."""
    d = directories(lv).where("leaves = 0 AND subdirs = 1 AND path <> ''")
    return d.select("wiki_id", "path", "depth", (F.col("depth") >= depth).alias("overdeep"))


def lift(lv: DataFrame) -> DataFrame:
    """leaf_no, path, new_path, parent: the only leaf of a directory two levels deep or more moves up."""
    lone = directories(lv).where("leaves = 1 AND subdirs = 0 AND depth >= 2").select("wiki_id", F.col("path").alias("parent_dir"), "depth")
    moved = lv.join(lone.withColumnRenamed("depth", "_d"), ["wiki_id", "parent_dir"])
    up = F.regexp_replace("parent_dir", r"/?[^/]*\z", "")
    return moved.select("leaf_no", "path", F.concat_ws("/", F.nullif(up, F.lit("")), F.substring_index("path", "/", -1)).alias("new_path"), F.when(up == "", "index.md").otherwise("../index.md").alias("parent"))


def flatten(lv: DataFrame) -> DataFrame:
    """leaf_no, path, new_path: what lies below a passthrough directory loses that segment."""
    hop = passthroughs(lv).select("wiki_id", F.col("path").alias("hop"))
    above = F.split("parent_dir", "/")
    up = lv.select("leaf_no", "wiki_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(above)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(above, 1, n), "/").alias("hop")))).alias("a")).select("leaf_no", "wiki_id", "path", "a.*")
    gone = up.join(hop, ["wiki_id", "hop"]).groupBy("leaf_no", "path").agg(F.collect_set("n").alias("gone"))
    parts = F.split("path", "/")
    keep = F.filter(F.transform(parts, lambda x, i: F.when(F.array_contains("gone", i + 1), None).otherwise(x)), lambda x: x.isNotNull())
    return gone.select("leaf_no", "path", F.array_join(keep, "/").alias("new_path"))


def decompose(lv: DataFrame) -> DataFrame:
    n = F.size(F.coalesce("covers", F.array().cast("array<string>")))
    return lv.where(n >= DECOMPOSE).select("leaf_no", n.alias("covers"), (n > DECOMPOSE).alias("shape_check"))


def nest_hints(lv: DataFrame) -> DataFrame:
    """leaf_no, hints: leaves whose domains say where they want to nest."""
    hints = F.array_distinct(F.filter(F.coalesce("domains", F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "")))
    return lv.where(F.size(hints) > 0).select("leaf_no", F.array_join(F.array_sort(hints), " ").alias("hints"))


def merge_pairs(lv: DataFrame) -> DataFrame:
    """dir, leaf_a, leaf_b: siblings of one type whose covers are alike; they meet over a common cover."""
    c = lv.select("dir", "type", "leaf_no", F.array_distinct(F.array_compact(F.coalesce("covers", F.array().cast("array<string>")))).alias("c"))
    flat = c.select("*", F.explode("c").alias("v"))
    a, b = (flat.select("dir", "type", "v", F.col("leaf_no").alias(f"leaf_{s}"), F.col("c").alias(f"c{s}")) for s in "ab")
    met = a.join(b, ["dir", "type", "v"]).where("leaf_a < leaf_b").dropDuplicates(["leaf_a", "leaf_b"])
    return met.where(jaccard(F.col("ca"), F.col("cb")) >= MERGE_COVERS).select("dir", "leaf_a", "leaf_b")


def merge_rows(lv: DataFrame) -> DataFrame:
    """keeper, absorbed, covers, tags, alias: what a merge of each alike pair makes.

    The longer focus survives, the first on a tie; lists are united in the keeper's order, and
    the absorbed id becomes an alias.
    """
    side = lambda s: lv.select(F.col("leaf_no").alias(f"leaf_{s}"), F.struct("leaf_no", "id", "focus", "covers", "tags").alias(s))
    p = merge_pairs(lv).join(side("a"), "leaf_a").join(side("b"), "leaf_b")
    first = F.length(F.coalesce("a.focus", F.lit(""))) >= F.length(F.coalesce("b.focus", F.lit("")))
    p = p.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("k"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("x"))
    both = lambda f: F.array_join(F.array_union(F.array_compact(F.coalesce(f"k.{f}", F.array().cast("array<string>"))), F.array_compact(F.coalesce(f"x.{f}", F.array().cast("array<string>")))), "\n")
    return p.select(F.col("k.leaf_no").alias("keeper"), F.col("x.leaf_no").alias("absorbed"), both("covers").alias("covers"), both("tags").alias("tags"), F.col("x.id").alias("alias"))


def _counted(rows: np.ndarray, terms: np.ndarray, width: int, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, term and how often it is there (``n`` times each), in order of the rows."""
    key = rows * max(width, 1) + terms
    if n is None:
        key, n = np.unique(key, return_counts=True)
    else:
        key, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, n, len(key))
    return key // max(width, 1), key % max(width, 1), n.astype(np.float64)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of lists and the row of each."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()


def _category_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each category and how often they are there: those of its leaves once for each of its pages."""
    for b in batches:
        (brow, below), (orow, own) = _flat(b["below"]), _flat(b["own"])
        names, at = np.unique(np.concatenate([below, own]), return_inverse=True)
        times = np.concatenate([b["pages"].to_numpy()[brow], np.ones(len(own), np.int64)])
        row, term, n = _counted(np.concatenate([brow, orow]), at, len(names), times)
        bounds = pa.array(np.searchsorted(row, np.arange(len(b) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (names[term], n.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([b["wiki_id"], b["home"], b["name"], *lists], ["wiki_id", "home", "name", "terms", "counts"])


class _Categories:
    """Some categories of a wiki by their terms, with what the wiki knows of all terms."""

    def __init__(self, known: pa.Table, cat: pa.Table):
        drow, names = _flat(known["terms"].combine_chunks())
        order = np.argsort(names)
        df = _flat(known["counts"].combine_chunks())[1]
        self.names, self.idf = names[order], np.log((1 + known["id"].to_numpy()[drow[order]]) / (1 + df[order])) + 1
        # categories by name, so that the smaller number is the smaller name
        title = np.array(cat["name"].to_pylist(), dtype=object)
        by_name = np.argsort(title, kind="stable")
        place = np.empty(len(title), np.int64)
        place[by_name] = np.arange(len(title))
        self.title, self.home = title[by_name], cat["id"].to_numpy()[by_name]
        row, term = _flat(cat["terms"].combine_chunks())
        row, term, w = self.weighed(place[row], term, len(title), _flat(cat["counts"].combine_chunks())[1])
        order = np.argsort(term, kind="stable")
        self.row, self.w, self.start = row[order], w[order], np.searchsorted(term[order], np.arange(len(names) + 1))

    def weighed(self, row, term, rows, n=None):
        row, term, w = _counted(row, np.searchsorted(self.names, term), len(self.names), n)
        w *= self.idf[term]
        return row, term, w / np.sqrt(np.bincount(row, w * w, rows))[row]

    def best(self, leaf: pa.RecordBatch) -> pa.RecordBatch:
        """leaf_no, dir, category, cosine of the ``SOFT_MOST`` of these categories that are most like each leaf."""
        title, start = self.title, self.start
        lrow, lterm, lw = self.weighed(*_flat(leaf["terms"]), len(leaf))
        many = np.diff(start)[lterm]
        bounds, work = np.searchsorted(lrow, np.arange(len(leaf) + 1)), np.concatenate([[0], np.cumsum(many)])
        own, found = leaf["home"].to_numpy(), []
        at = 0
        while at < len(leaf):
            to = int(np.searchsorted(work[bounds], work[bounds[at]] + SOFT_WORK, side="right")) - 1
            to = min(len(leaf), max(at + 1, min(to, at + SOFT_WORK // len(title))))
            x = slice(bounds[at], bounds[to])
            n = many[x]
            go = np.repeat(start[lterm[x]] - (work[x] - work[x.start]), n) + np.arange(n.sum())
            key = np.repeat((lrow[x] - at) * len(title), n) + self.row[go]
            score = np.round(np.bincount(key, np.repeat(lw[x], n) * self.w[go], (to - at) * len(title)), 6)
            hit = np.flatnonzero(score >= SOFT_LEAST)
            row, c = hit // len(title) + at, hit % len(title)
            other = own[row] != self.home[c]
            row, c, score = row[other], c[other], score[hit][other]
            order = np.lexsort((c, -score, row))
            row, c, score = row[order], c[order], score[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < SOFT_MOST
            found.append((row[keep], c[keep], score[keep]))
            at = to
        row, c, score = (np.concatenate(x) for x in zip(*found))
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([leaf["id"].take(at), leaf["name"].take(at), pa.array(title[c].tolist(), pa.string()), pa.array(score, pa.float64())], ["leaf_no", "dir", "category", "cosine"])


def _soft_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best categories of this block for each of its leaves. Terms (kind 0) and categories (1) come before the leaves (2), which are never held."""
    held: list = [[], []]
    block = None
    for b in batches:
        kind = b["kind"].to_numpy()
        for k in (0, 1):
            if (kind == k).any():
                if block is not None:
                    raise ValueError("a block must be in order of its kinds")
                held[k].append(b.filter(pa.array(kind == k)))
        if (kind == 2).any() and all(held):
            block = block or _Categories(*map(pa.Table.from_batches, held))
            yield block.best(b.filter(pa.array(kind == 2)))


def category_scores(lv: DataFrame, pg: DataFrame) -> DataFrame:
    """leaf_no, dir, category, cosine of leaves and the texts of other directories of their wiki, as far as these can be soft parents.

    One idf per wiki over leaves and categories; a category's text is its page's, and that of its
    direct leaves, as often as it has pages. ``lv`` has the hashed ``terms`` of a leaf or its ``tokens``.
    Leaves and categories of a wiki are compared in blocks, of which only the ``SOFT_MOST`` best categories
    of a leaf that reach ``SOFT_LEAST`` leave the task: what leaves and categories have in common term by
    term is never written. A block holds its categories and reads its leaves, so a wiki of any size writes its categories ``SOFT_PARTS`` times at most.
    """
    from thicket.functions.text import entry_text, tokenize

    terms = F.col("terms") if "terms" in lv.columns else hashed(F.col("tokens"))
    slim = lv.where("wiki_id IS NOT NULL").select("wiki_id", "leaf_no", "dir", F.xxhash64("dir").alias("home"), terms.alias("terms"))
    page = pg.where("wiki_id IS NOT NULL").select("wiki_id", F.xxhash64("dir").alias("home"), "dir", hashed(tokenize(entry_text(F.col("focus"), F.col("shared_covers")))).alias("terms"))
    both = slim.select("wiki_id", "home", F.lit(None).cast("string").alias("dir"), "terms").unionByName(page)
    cats = both.groupBy("wiki_id", "home").agg(
        F.max("dir").alias("name"), F.count("dir").alias("pages"),
        F.flatten(F.collect_list(F.when(F.col("dir").isNull(), F.col("terms")))).alias("below"), F.flatten(F.collect_list(F.when(F.col("dir").isNotNull(), F.col("terms")))).alias("own"),
    ).where("pages > 0")
    cats = cats.mapInArrow(_category_terms, "wiki_id string, home long, name string, terms array<bigint>, counts array<bigint>")
    # blocks of a wiki: leaves by number, categories by directory
    sizes = slim.groupBy("wiki_id").agg(F.count("*").alias("leaves")).join(page.groupBy("wiki_id").agg(F.count("*").alias("pages")), "wiki_id")
    parts = F.least(F.ceil(F.col("leaves") / SOFT_LEAVES), F.lit(SOFT_PARTS))
    sizes = cut(sizes.select("wiki_id", (F.col("leaves") + F.col("pages")).alias("n"), parts.cast("int").alias("ls"), F.ceil(F.greatest(F.col("leaves") / SOFT_BELOW, F.col("pages") / SOFT_PAGES)).cast("int").alias("cs")))
    held = slim.select("wiki_id", F.explode(F.array_distinct("terms")).alias("t")).unionByName(cats.select("wiki_id", F.explode("terms").alias("t")))
    df = held.groupBy("wiki_id", "t").agg(F.count("*").alias("df"))
    df = df.groupBy("wiki_id", F.pmod("t", F.lit(64)).alias("slice")).agg(F.collect_list(F.struct("t", "df")).alias("x"))
    df = df.select("wiki_id", F.transform("x", lambda x: x["t"]).alias("terms"), F.transform("x", lambda x: x["df"]).alias("counts"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    nothing = F.lit(None).cast("array<bigint>").alias("counts")
    known = df.join(sizes, "wiki_id").withColumn("l", every("ls")).select("wiki_id", "l", every("cs").alias("c"), F.lit(0).alias("kind"), F.col("n").alias("id"), F.lit(0).cast("long").alias("home"), F.lit(None).cast("string").alias("name"), "terms", "counts")
    cat = cats.where(F.size("terms") > 0).join(sizes, "wiki_id").select("wiki_id", every("ls").alias("l"), F.pmod("home", "cs").cast("int").alias("c"), F.lit(1).alias("kind"), F.col("home").alias("id"), "home", "name", "terms", "counts")
    leaf = slim.where(F.size("terms") > 0).join(sizes, "wiki_id").select("wiki_id", F.pmod(F.xxhash64("leaf_no"), "ls").cast("int").alias("l"), every("cs").alias("c"), F.lit(2).alias("kind"), F.col("leaf_no").alias("id"), "home", F.col("dir").alias("name"), "terms", nothing)
    rows = known.unionByName(cat).unionByName(leaf).repartition("wiki_id", "l", "c").sortWithinPartitions("wiki_id", "l", "c", "kind")
    return rows.groupBy("wiki_id", "l", "c").applyInArrow(_soft_block, "leaf_no long, dir string, category string, cosine double")


def soft_parents(lv: DataFrame, pg: DataFrame) -> DataFrame:
    """leaf_no, category, cosine, rank, parent: the other directories that a leaf belongs to as well."""
    rank = F.row_number().over(Window.partitionBy("leaf_no").orderBy(F.desc("cosine"), "category"))
    top = category_scores(lv, pg).withColumn("rank", rank).where(F.col("rank") <= SOFT_MOST)
    rel = F.concat_ws("/", F.nullif(relative_path(F.col("dir"), F.col("category")), F.lit("")), F.lit("index.md"))
    return top.select("leaf_no", "category", "cosine", "rank", rel.alias("parent"))


def soft_entries(lv: DataFrame, pg: DataFrame) -> DataFrame:
    """dir, id: leaves that other directories list because ``parents`` after the first name them."""
    p = lv.select("dir", "id", F.explode(F.slice("parents", 2, F.greatest(F.size("parents"), F.lit(1)))).alias("p")).where("p IS NOT NULL")
    steps = F.filter(F.split(F.concat_ws("/", "dir", "p"), "/"), lambda x: (x != ".") & (x != ""))
    walk = F.aggregate(steps, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))))
    to = F.regexp_replace(F.array_join(walk, "/"), r"/index\.md\z", "")
    named = p.select(to.alias("dir"), "id").join(pg.select("dir"), "dir", "left_semi").distinct()
    return named.join(lv.select("dir", "id"), ["dir", "id"], "left_anti")


def parents_after_containment(lv: DataFrame) -> DataFrame:
    """leaf_no, parents: as they are after the leaf moved into a directory of its own."""
    new = F.transform(F.array_compact(F.coalesce("parents", F.array().cast("array<string>"))), lambda p, i: F.when((i == 0) & (p == "index.md"), p).when(p.startswith("../"), p).otherwise(F.concat(F.lit("../"), p)))
    return lv.select("leaf_no", F.array_join(new, " ").alias("parents"))


def density(lv: DataFrame) -> DataFrame:
    """Specified only: wiki_id, density (distinct covers per byte) and weight (bytes by nearness to the root)."""
    covers = lv.select("wiki_id", F.explode("covers").alias("c")).where("c IS NOT NULL").distinct().groupBy("wiki_id").agg(F.count("*").alias("covers"))
    size = lv.groupBy("wiki_id").agg(F.sum("size_bytes").alias("bytes"), F.sum(F.col("size_bytes") * F.greatest(F.lit(1), 8 - F.col("depth"))).alias("weight"))
    return size.join(covers, "wiki_id", "left").select("wiki_id", F.round(F.coalesce("covers", F.lit(0)) / F.col("bytes"), 9).alias("density"), "weight")


# ---------------------------------------------------------------- DuckDB twins

_DIRS = f"""{LEAVES_SQL}, {PAGES_SQL},
own AS (SELECT wiki_id, parent_dir AS path, count(*) AS leaves FROM ent GROUP BY ALL),
alld AS (SELECT DISTINCT wiki_id, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS path FROM (SELECT wiki_id, path, unnest(generate_series(0, len(string_split(path, '/')))) AS n FROM own)),
sub AS (SELECT wiki_id, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*\\z', '') ELSE '' END AS path, count(*) AS subdirs FROM alld WHERE path <> '' GROUP BY ALL),
dirs AS (SELECT wiki_id, path, coalesce(leaves, 0) AS leaves, coalesce(subdirs, 0) AS subdirs, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth
  FROM alld LEFT JOIN own USING (wiki_id, path) LEFT JOIN sub USING (wiki_id, path))"""
_W = f"WITH {_DIRS} "
_C = "list_distinct(coalesce({}, []))"
_MERGE = f"""{_W}, mc AS (SELECT dir, type, leaf_no, id, focus, covers, tags, {_C.format('covers')} AS c FROM ent),
mp AS (SELECT a.dir, a.leaf_no AS leaf_a, b.leaf_no AS leaf_b FROM mc a JOIN mc b ON a.dir = b.dir AND a.type = b.type AND a.leaf_no < b.leaf_no
  WHERE len(list_intersect(a.c, b.c)) > 0 AND len(list_intersect(a.c, b.c)) >= {MERGE_COVERS} * (len(a.c) + len(b.c) - len(list_intersect(a.c, b.c))))"""
_UNION = "array_to_string(list_filter(list_concat(list_filter(coalesce({0}, []), lambda z: z IS NOT NULL), list_filter(coalesce({1}, []), lambda z: z IS NOT NULL)), lambda z, i: list_position(list_concat(list_filter(coalesce({0}, []), lambda y: y IS NOT NULL), list_filter(coalesce({1}, []), lambda y: y IS NOT NULL)), z) = i), chr(10))"
SQL = {
    "q_index_entries": _W + r"SELECT dir, id, regexp_replace(path, '^.*/', '') AS file, type, coalesce(nullif(focus, ''), array_to_string(list_transform(string_split(replace(id, '-', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')) AS focus FROM ent",
    "q_rebuild_index": _W + r""", en AS (SELECT wiki_id, parent_dir AS path, string_agg(concat_ws(' ', id, regexp_replace(path, '^.*/', ''), type), chr(10) ORDER BY regexp_replace(path, '^.*/', ''), concat_ws(' ', id, regexp_replace(path, '^.*/', ''), type)) AS entries FROM ent GROUP BY ALL),
ch AS (SELECT wiki_id, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*\z', '') ELSE '' END AS path, string_agg(regexp_replace(path, '^.*/', ''), chr(10) ORDER BY regexp_replace(path, '^.*/', '')) AS children FROM dirs WHERE path <> '' GROUP BY 1, 2),
hv AS (SELECT wiki_id, parent_dir AS path, value, count(*) AS k FROM (SELECT wiki_id, parent_dir, leaf_no, unnest(list_distinct(covers)) AS value FROM ent) GROUP BY ALL),
cv AS (SELECT wiki_id, path, string_agg(DISTINCT value, chr(10) ORDER BY value) AS shared_covers FROM (SELECT wiki_id, path, value FROM hv JOIN own USING (wiki_id, path) WHERE k = leaves AND leaves >= 2
  UNION ALL SELECT wiki_id, parent_dir, v FROM (SELECT wiki_id, parent_dir, unnest(shared_covers) AS v FROM page) WHERE v IS NOT NULL) GROUP BY ALL)
SELECT wiki_id, path, CASE WHEN depth = 0 THEN 'category' ELSE 'subcategory' END AS depth_role, entries, children, shared_covers FROM dirs LEFT JOIN en USING (wiki_id, path) LEFT JOIN ch USING (wiki_id, path) LEFT JOIN cv USING (wiki_id, path)""",
    "q_children": _W + r"SELECT up AS dir, id AS child, regexp_replace(parent_dir, '^.*/', '') || '/index.md' AS file FROM page WHERE parent_dir <> ''",
    "q_stubs": _W + "SELECT d.wiki_id, d.path, CASE WHEN depth = 0 THEN 'category' ELSE 'subcategory' END AS depth_role FROM dirs d ANTI JOIN page p ON p.wiki_id = d.wiki_id AND p.parent_dir = d.path",
    "q_shared_covers": _W + "SELECT dir, value FROM (SELECT dir, value, count(*) AS k FROM (SELECT dir, leaf_no, unnest(list_distinct(covers)) AS value FROM ent) GROUP BY ALL) JOIN (SELECT dir, count(*) AS n FROM ent GROUP BY ALL) USING (dir) WHERE k = n AND n >= 2",
    "q_stub_tags": _W + "SELECT dir, value FROM (SELECT dir, value, count(*) AS k FROM (SELECT dir, leaf_no, unnest(list_distinct(tags)) AS value FROM ent) GROUP BY ALL) JOIN (SELECT dir, count(*) AS n FROM ent GROUP BY ALL) USING (dir) WHERE k = n",
    "q_fanout": _W + f"SELECT wiki_id, path, leaves, subdirs, leaves > {OVERFULL * TARGET_FANOUT} AS overfull FROM dirs",
    "q_fanout_stats": _W + "SELECT wiki_id, max(leaves + subdirs) AS most, round(avg(leaves + subdirs), 6) AS mean, max(depth) AS depth FROM dirs GROUP BY wiki_id",
    "q_depth": _W + "SELECT wiki_id, path, depth FROM dirs",
    "q_passthrough": _W + f"SELECT wiki_id, path, depth, depth >= {MAX_DEPTH} AS overdeep FROM dirs WHERE leaves = 0 AND subdirs = 1 AND path <> ''",
    "q_lift": _W + r"""SELECT leaf_no, e.path, concat_ws('/', nullif(regexp_replace(parent_dir, '/?[^/]*\z', ''), ''), regexp_replace(e.path, '^.*/', '')) AS new_path,
CASE WHEN regexp_replace(parent_dir, '/?[^/]*\z', '') = '' THEN 'index.md' ELSE '../index.md' END AS parent FROM ent e JOIN dirs d ON d.wiki_id = e.wiki_id AND d.path = e.parent_dir WHERE leaves = 1 AND subdirs = 0 AND d.depth >= 2""",
    "q_flatten": _W + """, hop AS (SELECT wiki_id, path FROM dirs WHERE leaves = 0 AND subdirs = 1 AND path <> ''),
up AS (SELECT leaf_no, wiki_id, path, n, array_to_string(list_slice(string_split(parent_dir, '/'), 1, n), '/') AS hop FROM (SELECT *, unnest(generate_series(1, len(string_split(parent_dir, '/')))) AS n FROM ent)),
gone AS (SELECT leaf_no, up.path, list(DISTINCT n) AS gone FROM up JOIN hop ON hop.wiki_id = up.wiki_id AND hop.path = up.hop GROUP BY ALL)
SELECT leaf_no, path, array_to_string(list_filter(string_split(path, '/'), lambda x, i: NOT list_contains(gone, i)), '/') AS new_path FROM gone""",
    "q_decompose": _W + f"SELECT leaf_no, len(covers)::INTEGER AS covers, len(covers) > {DECOMPOSE} AS shape_check FROM ent WHERE len(covers) >= {DECOMPOSE}",
    "q_nest_hint": _W + "SELECT leaf_no, array_to_string(list_sort(list_distinct(list_filter(domains, lambda x: trim(x) <> ''))), ' ') AS hints FROM ent WHERE len(list_filter(domains, lambda x: trim(x) <> '')) > 0",
    "q_merge_pairs": _MERGE + " SELECT dir, leaf_a, leaf_b FROM mp",
    "q_merge_rows": _MERGE + f""", kx AS (SELECT CASE WHEN length(coalesce(a.focus, '')) >= length(coalesce(b.focus, '')) THEN a ELSE b END AS k, CASE WHEN length(coalesce(a.focus, '')) >= length(coalesce(b.focus, '')) THEN b ELSE a END AS x
  FROM mp JOIN mc a ON a.leaf_no = leaf_a JOIN mc b ON b.leaf_no = leaf_b)
SELECT k.leaf_no AS keeper, x.leaf_no AS absorbed, {_UNION.format('k.covers', 'x.covers')} AS covers, {_UNION.format('k.tags', 'x.tags')} AS tags, x.id AS alias FROM kx""",
    "q_parent_rewrite": _W + "SELECT leaf_no, array_to_string(list_transform(list_filter(coalesce(parents, []), lambda p: p IS NOT NULL), lambda p, i: CASE WHEN (i = 1 AND p = 'index.md') OR starts_with(p, '../') THEN p ELSE '../' || p END), ' ') AS parents FROM ent",
    "q_density": _W + "SELECT wiki_id, round(coalesce(covers, 0) / bytes, 9) AS density, weight FROM (SELECT wiki_id, sum(size_bytes)::BIGINT AS bytes, sum(size_bytes * greatest(1, 8 - depth))::BIGINT AS weight FROM ent GROUP BY 1) LEFT JOIN (SELECT wiki_id, count(DISTINCT c) AS covers FROM (SELECT wiki_id, unnest(covers) AS c FROM ent) GROUP BY 1) USING (wiki_id)",
}
_SOFT = f"""{_W},
pt AS (SELECT wiki_id, dir, {{tokens}} AS tokens FROM page),
raw AS (SELECT wiki_id, 'L' || leaf_no AS key, unnest(tok.tokens) AS term FROM ent JOIN tok USING (leaf_no)
  UNION ALL SELECT page.wiki_id, 'C' || page.dir, unnest(tok.tokens) FROM page JOIN tok ON tok.dir = page.dir
  UNION ALL SELECT wiki_id, 'C' || dir, unnest(tokens) FROM pt),
tf AS (SELECT wiki_id, key, term, count(*) AS tf FROM raw GROUP BY ALL),
nn AS (SELECT wiki_id, count(*) AS n FROM (SELECT wiki_id, leaf_no::VARCHAR FROM ent UNION ALL SELECT wiki_id, dir FROM page) GROUP BY 1),
w AS (SELECT wiki_id, key, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN (SELECT wiki_id, term, count(*) AS df FROM tf GROUP BY ALL) USING (wiki_id, term) JOIN nn USING (wiki_id)),
u AS (SELECT wiki_id, key, term, w / norm AS w FROM w JOIN (SELECT wiki_id, key, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL) USING (wiki_id, key)),
sc AS (SELECT substr(a.key, 2)::BIGINT AS leaf_no, substr(b.key, 2) AS category, round(sum(a.w * b.w), 6) AS cosine FROM u a JOIN u b USING (wiki_id, term) WHERE a.key LIKE 'L%' AND b.key LIKE 'C%' GROUP BY ALL)
SELECT leaf_no, category, cosine, row_number() OVER (PARTITION BY leaf_no ORDER BY cosine DESC, category)::INTEGER AS rank FROM sc JOIN ent USING (leaf_no) WHERE category <> dir AND cosine >= {SOFT_LEAST}
QUALIFY row_number() OVER (PARTITION BY leaf_no ORDER BY cosine DESC, category) <= {SOFT_MOST}"""
from thicket.functions.text import STRIP, TOKENS, _LIST as _TEXT_LIST  # noqa: E402

SQL["q_soft_parents"] = _SOFT.replace("{tokens}", TOKENS.format(STRIP.format("concat_ws(' ', focus, focus, " + _TEXT_LIST.format("shared_covers") + ")")))


def queries() -> dict:
    lv = lambda fn: lambda s, d: fn(leaves(s, d))
    both = lambda fn: lambda s, d: fn(leaves(s, d), pages(s, d))
    texts = lambda fn: lambda s, d: fn(leaf_terms(s, d), pages(s, d))
    return {
        "q_index_entries": lv(index_entries), "q_children": lambda s, d: children(pages(s, d)), "q_rebuild_index": both(rebuilt_index), "q_stubs": both(stubs),
        "q_shared_covers": lv(lambda x: shared(x, "covers")), "q_stub_tags": lv(lambda x: shared(x, "tags", 1)),
        "q_fanout": lv(fanout), "q_fanout_stats": lv(fanout_stats), "q_depth": lv(lambda x: directories(x).select("wiki_id", "path", "depth")), "q_passthrough": lv(passthroughs),
        "q_lift": lv(lift), "q_flatten": lv(flatten), "q_decompose": lv(decompose), "q_nest_hint": lv(nest_hints), "q_merge_pairs": lv(merge_pairs), "q_merge_rows": lv(merge_rows),
        "q_parent_rewrite": lv(parents_after_containment), "q_density": lv(density),
        "q_soft_parents": texts(lambda x, p: soft_parents(x, p).drop("parent")), "q_soft_links": texts(soft_parents), "q_soft_entries": both(soft_entries),
    }
