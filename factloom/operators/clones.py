"""Clones of functions and of token blocks.

Exact, structure and signature clones are hash groups. Near clones come from an inverted index of rare call tokens: tokens below the
IDF cut are dropped before the join, each pair meets in one bucket only (its first shared retained token), and the compatibility of a
pair is part of the join. Block clones link neighbouring occurrences of equal k-grams and merge links along diagonals.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import materialize, spread
from .pairs import BLOCK, meet

# fixed values of the near-function policy
GENERIC_CALL_TOKENS = ("apply", "bind", "call", "catch", "filter", "find", "forEach", "format", "includes", "join", "map", "push", "reduce", "slice", "split", "then", "toString", "trim")
MIN_IDF, MIN_SIMILARITY, MIN_SCORE = 3.0, 0.34, 0.62
IDF_SATURATION, MIN_IDF_SCORE, MIN_NAME_JACCARD = 6.0, 0.5, 0.34
WEIGHTS = (0.45, 0.25, 0.15, 0.15)


def hash_groups(facts: DataFrame, key: str, min_loc: int, min_statements: int, least: int = 2) -> DataFrame:
    """Groups of at least `least` functions of equal hash; functions that are too small and null hashes are no members.
    Members are counted and bounded per group in the shuffle; the listing of members is joined by whoever wants it."""
    f = facts.where(F.col(key).isNotNull() & (F.col("body_loc") >= min_loc) & (F.col("statement_count") >= min_statements))
    g = f.groupBy(F.col(key).alias("hash")).agg(
        F.count("*").alias("size"),
        F.count_distinct("owner_file").alias("files"),
        F.min("body_loc").alias("min_loc"),
        F.max("body_loc").alias("max_loc"),
        F.bool_and("generated").alias("generated_only"),
        F.min("identity").alias("first_identity"),
    )
    return g.where(F.col("size") >= least)


def shared_tokens(facts: DataFrame, key: str) -> DataFrame:
    """Call tokens that every member of a hash group has."""
    sizes = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n >= 2")
    t = facts.join(sizes, key).select(F.col(key).alias("hash"), "n", "identity", F.explode("call_tokens").alias("token")).groupBy("hash", "n", "token").agg(F.count_distinct("identity").alias("c"))
    return t.where("c = n").groupBy("hash").agg(F.array_join(F.array_sort(F.collect_set("token")), ",").alias("tokens"))


def name_tokens(name: Column) -> Column:
    """Lower-case words of a camel, snake or kebab name, sorted, distinct, two characters and more."""
    words = F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def range_similarity(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.when(top <= 0, 0.0).otherwise(1.0 - F.abs(a - b) / top)


def significant(facts: DataFrame) -> DataFrame:
    """facts with sig: distinct call tokens of four bytes and more that are not generic."""
    generic = F.array(*[F.lit(t) for t in GENERIC_CALL_TOKENS])
    return facts.withColumn("sig", F.array_sort(F.array_except(F.filter(F.array_distinct("call_tokens"), lambda t: F.octet_length(t) >= 4), generic)))


def token_idf(facts: DataFrame) -> DataFrame:
    """token, df, idf over all facts(identity, sig)."""
    n = facts.agg(F.count("*").alias("n"))
    df = facts.select(F.explode("sig").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("token", "df", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)).alias("idf"))  # n is one row


def near_functions(facts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every pair of near clones with its score. Members of exact or structure groups and functions without tokens take no part;
    scores are rounded to three places before they are compared. Functions meet at a token, with equal is_async; those of a
    frequent token meet in blocks (`pairs.meet`), so no token is one task."""
    # facts come from source texts: they are extracted once, and the index that both sides of the join read is written once
    facts = materialize(facts.select("identity", "name", "body_loc", "statement_count", "param_count", "is_async", "generated", "owner_file", "exact_hash", "structure_hash", "call_tokens"), "near-facts")
    f = significant(facts)
    idf = materialize(token_idf(f), "near-idf")
    for key, loc, st in (("exact_hash", 1, 1), ("structure_hash", 3, 2)):
        big = hash_groups(facts, key, loc, st).select(F.col("hash").alias(key), F.lit(True).alias("grouped"))
        member = F.col("grouped") & (F.col("body_loc") >= loc) & (F.col("statement_count") >= st)
        f = f.join(big, key, "left").where(~F.coalesce(member, F.lit(False))).drop("grouped")
    f = f.where(F.size("sig") > 0)
    post = f.select("identity", F.explode("sig").alias("token")).join(idf.where(F.col("idf") >= MIN_IDF).select("token"), "token")
    kept = post.groupBy("identity").agg(F.array_sort(F.collect_list("token")).alias("retained"))
    f = f.join(kept, "identity").withColumn("words", name_tokens(F.col("name")))
    one = materialize(f.select("identity", "is_async", "param_count", "body_loc", "statement_count", "sig", "retained", "words", "generated"), "near-index")
    at = one.withColumn("token", F.explode("retained")).withColumn("lane", F.col("is_async"))
    crowd = at.groupBy("token", "lane").agg(F.count("*").alias("crowd")).where("crowd > 1")
    met = meet(at.join(crowd, ["token", "lane"]), ["token", "lane"], "identity", "crowd", block)
    met = met.select("token", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "lr" for c in one.columns])
    loc_sim, st_sim = range_similarity(F.col("l_body_loc"), F.col("r_body_loc")), range_similarity(F.col("l_statement_count"), F.col("r_statement_count"))
    pairs = met.where((F.abs(F.col("l_param_count") - F.col("r_param_count")) <= 1) & (loc_sim >= MIN_SIMILARITY) & (st_sim >= MIN_SIMILARITY))
    pairs = pairs.where(F.col("token") == F.array_min(F.array_intersect("l_retained", "r_retained")))
    shared = pairs.withColumn("shared", F.array_intersect("l_sig", "r_sig"))
    # sums in token order, so that they do not depend on the plan
    sums = shared.select("l_identity", "r_identity", F.posexplode("shared").alias("pos", "token")).join(idf.select("token", "idf"), "token")
    sums = sums.groupBy("l_identity", "r_identity").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("pos", "idf"))), F.lit(0.0), lambda a, x: a + x["idf"]).alias("idf_sum"))
    scored = shared.join(sums, ["l_identity", "r_identity"])
    idf_score, names = F.least(F.col("idf_sum") / IDF_SATURATION, F.lit(1.0)), jaccard(F.col("l_words"), F.col("r_words"))
    score = F.round(idf_score * WEIGHTS[0] + names * WEIGHTS[1] + loc_sim * WEIGHTS[2] + st_sim * WEIGHTS[3], 3)
    scored = scored.where((idf_score >= MIN_IDF_SCORE) | (names >= MIN_NAME_JACCARD)).withColumn("score", score).where(F.col("score") >= MIN_SCORE)
    return scored.select("l_identity", "r_identity", "score", F.array_join("shared", ",").alias("shared_tokens"), (F.col("l_generated") & F.col("r_generated")).alias("generated_only"))


def near_diagnostics(facts: DataFrame) -> DataFrame:
    """Buckets of tokens below the IDF cut, by the pairs they would have made."""
    idf = token_idf(significant(facts)).where(F.col("idf") < MIN_IDF)
    return idf.select("token", F.col("df").alias("functions"), F.expr("df * (df - 1) div 2").alias("skipped_pairs"))


#: fixed values: reserved words, which stand for themselves; what begins a scope at the margin of a line
RESERVED = (
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof "
    "new null return super switch this throw true try typeof var void while with yield let static implements interface package private protected public async of"
).split()
SCOPE = "^(?:export|async|function|class|const|let|var|interface|type|enum|abstract|declare) "
TOKEN = "[.]?[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+|[^ A-Za-z0-9_$]"
WINDOWS = "hash bigint, file bigint, pos bigint, line bigint, end_line bigint"
_BASE = 0x9E3779B97F4A7C15


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little")


def _windows(file: int, values: np.ndarray, lines: np.ndarray, k: int, pos: int = 0) -> pa.RecordBatch:
    """Hash, place and lines of every window of k values of a file (a polynomial modulo 2 ** 64, rolled over all windows at once)."""
    n = max(0, len(values) - k + 1)
    if n:
        up, down = (np.full(len(values), x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * down)])
        hashes = ((sums[k:] - sums[:-k]) * up[k - 1 :]).view(np.int64)
    else:
        hashes = np.empty(0, np.int64)
    cols = (hashes, np.full(n, file, np.int64), pos + np.arange(n), lines[:n], lines[k - 1 : k - 1 + n])
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=[c.split()[0] for c in WINDOWS.split(", ")])


def _of_texts(k: int):
    token, scope, reserved = re.compile(TOKEN), re.compile(SCOPE), frozenset(RESERVED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for file, text in zip(b.column("file").to_pylist(), b.column("text").to_pylist()):
                values, lines, slots = [], [], {}
                for at, body in enumerate((text or "").split("\n")):
                    if scope.match(body):
                        slots = {}
                    for t in token.findall(body):
                        c = t[0]
                        if c.isalpha() or c in "_$":
                            if t not in reserved:
                                t = slots.setdefault(t, f"${len(slots) + 1}")
                        elif c.isdigit():
                            t = "0"
                        v = known.get(t)
                        if v is None:
                            if len(known) > 1_000_000:
                                known.clear()
                            known[t] = v = _digest(t)
                        values.append(v)
                        lines.append(at)
                if len(values) >= k:
                    yield _windows(file, np.array(values, np.uint64), np.array(lines, np.int64), k)

    return run


def _of_tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, values, lines = None, [], []

        def done():
            return _windows(file, np.concatenate(values).view(np.uint64), np.concatenate(lines), k)

        for b in batches:
            files, v, at = (b.column(c).to_numpy(zero_copy_only=False) for c in ("file", "value", "line"))
            for part in np.split(np.arange(len(files)), np.flatnonzero(np.diff(files)) + 1) if len(files) else ():
                if file is not None and files[part[0]] != file:
                    yield done()
                    values, lines = [], []
                file = files[part[0]]
                values.append(v[part])
                lines.append(at[part])
        if file is not None:
            yield done()

    return run


def text_windows(files: DataFrame, k: int = 50) -> DataFrame:
    """Windows of k normalised tokens of files(file, text) of TypeScript and JavaScript, one pass over each text. Identifiers are slots
    numbered by first use within what begins at the margin; reserved words, properties (.name) and signs stand for themselves, numbers are 0."""
    return spread(files.select("file", "text")).mapInArrow(_of_texts(k), WINDOWS)


def token_windows(tokens: DataFrame, k: int = 50) -> DataFrame:
    """Windows of k values of tokens(file, pos, value, line), pos from 0 without gaps. The values of one file are held by one task."""
    t = tokens.select("file", "pos", F.xxhash64("value").alias("value"), "line")
    return t.repartition("file").sortWithinPartitions("file", "pos").select("file", "value", "line").mapInArrow(_of_tokens(k), WINDOWS)


def block_clones(tokens: DataFrame, k: int = 50, min_lines: int = 5, chunk: Column | None = None) -> DataFrame:
    """Maximal equal token runs between neighbouring occurrences in tokens(file, pos, value, line); see `linked_windows`."""
    return linked_windows(token_windows(tokens, k), k, min_lines, chunk)


def linked_windows(windows: DataFrame, k: int = 50, min_lines: int = 5, chunk: Column | None = None, per_chunk: int = 10_000) -> DataFrame:
    """Maximal equal token runs between neighbouring occurrences of the windows(hash, file, pos, line, end_line).

    Only windows that occur twice go on. They are put in order (file, pos) within chunks of files (by the hash of the file, about
    per_chunk files and 64 chunks at least, or the given column), and neighbours are linked, as are the first windows of the chunks; so a
    window with m occurrences gives m - 1 links, and boilerplate that is everywhere is not one unit of work. An occurrence whose neighbour
    overlaps it is linked to the first one of its file that does not, and the first of a file to the first of the next file, whatever
    overlaps between. Links of one diagonal (same two files, same distance) at consecutive positions are one run."""
    windows = materialize(windows, "clone-windows")
    again_and_again = windows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    if chunk is None:
        files = windows.select("file").distinct().count()
        chunk = F.pmod(F.xxhash64("file"), F.lit(max(64, -(-files // per_chunk))))
    grams = windows.join(again_and_again, "hash", "left_semi").select("hash", "file", "pos", "line", "end_line", chunk.alias("chunk"))
    grams = materialize(grams, "clone-repeats")
    after = lambda v: [F.lead(c).over(v).alias(f"{c}2") for c in ("file", "pos", "line", "end_line")]
    within = Window.partitionBy("hash", "chunk").orderBy("file", "pos")
    inner = grams.select("hash", "file", "pos", "line", "end_line", *after(within))
    # the first occurrence of the file at a distance of k and more, where the neighbour overlaps
    far = Window.partitionBy("hash", "file").orderBy("pos").rangeBetween(k, Window.unboundedFollowing)
    own = Window.partitionBy("hash", "file").orderBy("pos")
    again = grams.withColumn("next", F.lead("pos").over(own)).withColumn("f", F.first(F.struct("file", "pos", "line", "end_line")).over(far))
    again = again.where((F.col("next") - F.col("pos") < k) & F.col("f").isNotNull()).select("hash", "file", "pos", "line", "end_line", *[F.col(f"f.{c}").alias(f"{c}2") for c in ("file", "pos", "line", "end_line")])
    # a file with overlapping occurrences: its first to the first of the next file of the chunk
    firsts = grams.groupBy("hash", "chunk", "file").agg(F.min(F.struct("pos", "line", "end_line")).alias("h"), F.max("pos").alias("end")).select("hash", "chunk", "file", "h.*", "end")
    crossing = firsts.select("hash", "file", "pos", "line", "end_line", "end", *after(Window.partitionBy("hash", "chunk").orderBy("file"))).where("end > pos")
    lapped = grams.withColumn("next", F.lead("pos").over(own)).where(F.col("next") - F.col("pos") < k).select("hash", "file").distinct()
    crossing = crossing.join(lapped, ["hash", "file"], "left_semi").drop("end")
    heads = grams.groupBy("hash", "chunk").agg(F.min(F.struct("file", "pos", "line", "end_line")).alias("h")).select("hash", "chunk", "h.*")  # as many rows a hash as chunks
    outer = heads.select("hash", "file", "pos", "line", "end_line", *after(Window.partitionBy("hash").orderBy("chunk")))
    links = inner.unionByName(outer).unionByName(again).unionByName(crossing).where("file2 IS NOT NULL")
    links = links.where((F.col("file") != F.col("file2")) | (F.col("pos2") - F.col("pos") >= k))
    diag = Window.partitionBy("file", "file2", F.col("pos2") - F.col("pos")).orderBy("pos")
    runs = links.withColumn("island", F.col("pos") - F.row_number().over(diag)).withColumn("delta", F.col("pos2") - F.col("pos"))
    runs = runs.groupBy("file", "file2", "delta", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("last"), F.min("line").alias("line"), F.max("end_line").alias("end_line"), F.min("line2").alias("line2"), F.max("end_line2").alias("end_line2"))
    runs = runs.where((F.col("end_line") - F.col("line") + 1 >= min_lines) & (F.col("end_line2") - F.col("line2") + 1 >= min_lines))
    return runs.select("file", "file2", "start", (F.col("start") + F.col("delta")).alias("start2"), (F.col("last") - F.col("start") + k).alias("tokens"), "line", "end_line", "line2", "end_line2")


def block_policy(path: Column, path2: Column) -> Column:
    """First reason that mutes a pair of files, or review."""
    test = lambda p: p.rlike(r"(^|/)tests?/|[.](test|spec)[.]")
    return F.when(path == path2, "muted:same-file-repeat").when(test(path) & test(path2), "muted:test-scaffold").otherwise("review")
