"""Problem 1: source files that do not parse.

Every text is lexed and run through the chart parser of its language (`syntax.engine`); the least cost of a repair is 0 for a
valid file. Files of cost above 0 are invalid; where the edits lie tells truncation, conflict, mismatch and local damage apart.

Cases: null text is unreadable, neither valid nor invalid; an unknown extension gives no verdict; an empty text is valid except
in Go and JSON; repeats of one source_file_id count once; an empty table gives an empty result. Other columns pass by unread.
The work is a map over files, so no repo or language is a hot key; only narrow verdict rows are shuffled.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import spread
from .syntax.check import EXTENSIONS, check

VERDICT = "source_file_id bigint, repo string, language string, readable boolean, edit_cost int, cost_exact boolean, damage string, damage_offset bigint"


def _verdicts(pairs: int | None, max_cost: int, beam: int, sure: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collects = gc.isenabled()
        for b in batches:
            out: dict[str, list] = {k.split()[0]: [] for k in VERDICT.split(", ")}
            gc.disable()  # the chart has no cycles, and walking its columns over and over costs more than parsing
            for fid, repo, file, text in zip(*(b.column(c).to_pylist() for c in ("source_file_id", "repo", "file", "text"))):
                language = EXTENSIONS.get(file.rsplit(".", 1)[-1].lower()) if file and "." in file else None
                v = check(text, language, pairs, max_cost, beam, sure) if text is not None and language else None
                row = (fid, repo, language, text is not None, *((v.cost, v.exact, v.kind, v.offset) if v else (None, None, None, None)))
                for k, x in zip(out, row):
                    out[k].append(x)
            if collects:
                gc.enable()
            types = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types)], names=list(out))

    return run


def parse_verdicts(files: DataFrame, pairs: int | None = 12_000, max_cost: int = 12, beam: int = 300, sure: bool = True) -> DataFrame:
    """One verdict per row of files(source_file_id, repo, file, text). pairs, max_cost and beam bound the search for the cheapest
    repair of an invalid file, never whether it is found invalid; edit_cost is then an upper bound (cost_exact false). pairs=None
    searches until the repair is proven least, however long that takes. damage is proven whatever the bounds (max_cost is also the
    most edits of local damage); with sure=False it follows from the repair found."""
    df = spread(files.select("source_file_id", "repo", "file", "text"))
    return df.mapInArrow(_verdicts(pairs, max_cost, beam, sure), VERDICT)


def invalid_files(files: DataFrame) -> DataFrame:
    return parse_verdicts(files, sure=False).where("edit_cost > 0").select("source_file_id").distinct()


def invalid_rates(files: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repo and per language (the other column is null), by kind of damage.
    The rate is over readable files of known language; null where there are none. No count hangs on a bound of the repair search."""
    one = parse_verdicts(files).dropDuplicates(["source_file_id"])
    kinds = ("truncation", "conflict", "mismatch", "local")
    return (
        one.groupBy("repo", "language", F.col("readable"))
        .agg(F.count("*").alias("n"), F.count("edit_cost").alias("judged"), F.count_if(F.col("edit_cost") > 0).alias("bad"), *(F.count_if(F.col("damage") == k).alias(k) for k in kinds))
        .groupingSets([[F.col("repo")], [F.col("language")]], "repo", "language")
        .agg(
            F.when(F.grouping("language") == 1, "repo").otherwise("language").alias("grouped_by"),
            F.sum("n").alias("files"),
            F.sum(F.when(F.col("readable"), 0).otherwise(F.col("n"))).alias("unreadable"),
            F.sum("bad").alias("invalid"),
            *(F.sum(k).alias(k) for k in kinds),
            F.round(F.try_divide(F.sum("bad"), F.sum("judged")), 6).alias("invalid_rate"),
        )
    )
