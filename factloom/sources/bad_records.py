"""Problem 3: load the rows that parse, and set apart those that do not with the reason.

Records are parsed in blocks on a fast path: JSON lines by one call of the C parser over a whole block, comma-separated records
by the columnar CSV reader with typed columns. A block that fails is bisected; what is left of it when its parts are small is diagnosed
strictly, record by record. Blocks of comma-separated records grow while they load and shrink where records are bad, so clean files are
read at the speed of the reader, and dirty ones are not parsed over and over.

Cases: null or empty text has no lines; blank lines (spaces and tabs) are no records; a null raw record has no fields and fails with
'columns'; identical records are loaded as often as they occur; repeats of a run count once; very long streams are split into lines
before any Python, so no stream is a unit of work; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import re
import secrets
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strict_json import loads
from ..plans.session import spread

BLOCK = 256

# ---- JSON lines ---------------------------------------------------------------------------------------------------------
LINES = "run_id bigint, line_no bigint, ok boolean, event string, detail string, line string"


def stream_lines(runs: DataFrame) -> DataFrame:
    """run_id, line_no (from 1), line of every line that is not blank; done by the JVM."""
    # a carriage return before the line feed is not part of the line
    rows = runs.where(F.length("stdout") > 0).select("run_id", F.posexplode(F.split("stdout", "\r?\n", -1)).alias("pos", "line"))
    rows = rows.select("run_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    return rows.where(~F.col("line").rlike(r"\A[ \t]*\z"))


def _parse_block(lines: list[str], lo: int, hi: int, out: list) -> None:
    """Fill out[lo:hi] with (ok, event, detail)."""
    if hi - lo > 2:
        nonce = f'"{secrets.token_hex(12)}"'  # no line can hold it, so no two wrong lines can make up for each other
        try:
            got = loads(f"[{f',{nonce},'.join(lines[lo:hi])}]")
            sep = nonce[1:-1]
            if isinstance(got, list) and len(got) == 2 * (hi - lo) - 1 and all(type(x) is dict for x in got[::2]) and all(x == sep for x in got[1::2]):
                out[lo:hi] = [(True, _event(x), None) for x in got[::2]]
                return
        except ValueError:
            pass
        mid = (lo + hi) // 2
        _parse_block(lines, lo, mid, out)
        _parse_block(lines, mid, hi, out)
        return
    for i in range(lo, hi):
        try:
            x = loads(lines[i])
            out[i] = (True, _event(x), None) if type(x) is dict else (False, None, f"a JSON {type(x).__name__}, not an object")
        except ValueError as e:
            out[i] = (False, None, str(e)[:200])


def _event(x: dict) -> str | None:
    r = x.get("reason")
    return r if isinstance(r, str) else None


def _json_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = b.column("line").to_pylist()
        out: list = [None] * len(lines)
        for lo in range(0, len(lines), BLOCK):
            _parse_block(lines, lo, min(lo + BLOCK, len(lines)), out)
        ok, event, detail = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column("run_id"), b.column("line_no"), pa.array(ok, pa.bool_()), pa.array(event, pa.string()), pa.array(detail, pa.string()), b.column("line")],
            names=[c.split()[0] for c in LINES.split(", ")],
        )


def load_json_lines(runs: DataFrame) -> DataFrame:
    """Every line of runs(run_id, stdout) that is not blank: ok and its "reason" as event, or not ok and the detail."""
    return spread(stream_lines(runs)).mapInArrow(_json_lines, LINES)


# ---- comma-separated records ---------------------------------------------------------------------------------------------
FIELDS = ("run_id", "coverage_kind", "status", "stream_parse_status", "invalid_json_line_count", "exit_code", "elapsed_ms", "command", "observed_at", "clean")
RECORDS = (
    "raw_id bigint, file_name string, line_no bigint, reason string, detail string, run_id bigint, coverage_kind string, status string, stream_parse_status string, "
    "invalid_json_line_count bigint, exit_code int, elapsed_ms bigint, command string, observed_at timestamp, clean boolean"
)
_KINDS = {
    "coverage_kind": ("event-stream", "absence-clean"),
    "status": ("complete", "partial", "unavailable", "skipped"),
    "stream_parse_status": ("complete", "invalid-json", "no-json-events", "not-run", ""),
    "clean": ("true", "false", ""),
}
_FORMATS = {
    "run_id": "[0-9]{1,18}",
    "invalid_json_line_count": "(?:[0-9]{1,18})?",
    "exit_code": "(?:-?[0-9]{1,9})?",
    "elapsed_ms": "[0-9]{1,18}",
    "observed_at": "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z",
} | {k: "(?:" + "|".join(map(re.escape, v)) + ")" for k, v in _KINDS.items()}
#: what the fast path takes: the exact format of every field, bare or quoted
_FAST = r"\A" + ",".join('(?:[^",\\n\\r]*|"(?:[^"]|"")*")' if f == "command" else f'(?:{_FORMATS[f]}|"{_FORMATS[f]}")' for f in FIELDS) + r"\z"
_TYPES = {
    "run_id": pa.int64(), "coverage_kind": pa.string(), "status": pa.string(), "stream_parse_status": pa.string(), "invalid_json_line_count": pa.int64(),
    "exit_code": pa.int32(), "elapsed_ms": pa.int64(), "command": pa.string(), "observed_at": pa.timestamp("s", tz="UTC"), "clean": pa.bool_(),
}
_INT = re.compile(r"-?[0-9]+", re.A)
_TIME = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z", re.A)


def split_record(record: str) -> list[str] | None:
    """Fields by RFC 4180, or None where the quoting is not well formed."""
    fields, i, n = [], 0, len(record)
    while True:
        if i < n and record[i] == '"':
            j, part = i + 1, []
            while True:
                k = record.find('"', j)
                if k < 0:
                    return None
                part.append(record[j:k])
                if record[k + 1 : k + 2] != '"':
                    break
                part.append('"')
                j = k + 2
            i = k + 1
            if i < n and record[i] != ",":
                return None
            fields.append("".join(part))
        else:
            k = record.find(",", i)
            k = n if k < 0 else k
            part = record[i:k]
            if '"' in part:
                return None
            fields.append(part)
            i = k
        if i >= n:
            return fields
        i += 1


def _int(text: str, bits: int, least: int | None) -> int:
    if not _INT.fullmatch(text):
        raise ValueError
    v = int(text)
    if not -(1 << (bits - 1)) <= v < 1 << (bits - 1) or (least is not None and v < least):
        raise ValueError
    return v


def diagnose(record: str | None) -> tuple[str | None, str | None, tuple | None]:
    """(reason, detail, None) of a bad record, or (None, None, typed values)."""
    if record is None:
        return "columns", "no record", None
    fields = split_record(record)
    if fields is None:
        return "quoting", None, None
    if len(fields) != len(FIELDS):
        return "columns", f"{len(fields)} fields", None
    values = []
    for name, text in zip(FIELDS, fields):
        try:
            if name in ("run_id", "elapsed_ms"):
                values.append(_int(text, 64, 0))
            elif name == "invalid_json_line_count":
                values.append(_int(text, 64, 0) if text else None)
            elif name == "exit_code":
                values.append(_int(text, 32, None) if text else None)
            elif name == "observed_at":
                if not _TIME.fullmatch(text):
                    raise ValueError
                values.append(datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc))
            elif name in _KINDS:
                if text not in _KINDS[name]:
                    raise ValueError
                values.append({"true": True, "false": False, "": None}[text] if name == "clean" else text)
            else:
                values.append(text)
        except ValueError:
            return "value", name, None
    return None, None, tuple(values)


_SCHEMA = pa.schema([("reason", pa.string()), ("detail", pa.string()), *_TYPES.items()])


#: blocks begin at START records, double where they load and halve where they fail; a failing block of LEAF records is diagnosed. Where
#: SMALLEST ones fail again and again, ever longer runs are diagnosed without trying, up to LARGEST records
START, SMALLEST, LARGEST, LEAF = 512, 128, 8192, 32


def _load_block(raw: pa.Array, lo: int, hi: int) -> pa.Table | None:
    """Typed columns of a block of records by the columnar reader, or None where any of them does not load. What the reader takes but the
    format does not allow (blanks around numbers, quotes inside bare fields) fails the block too."""
    block = raw.slice(lo, hi - lo)
    if block.null_count:
        return None
    try:
        got = pyarrow.csv.read_csv(
            io.BytesIO("\n".join(block.to_pylist()).encode() + b"\n"),
            pyarrow.csv.ReadOptions(column_names=list(FIELDS), use_threads=False),
            pyarrow.csv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            pyarrow.csv.ConvertOptions(column_types=_TYPES, null_values=[""], strings_can_be_null=False, true_values=["true"], false_values=["false"]),
        )
    except pa.ArrowInvalid:
        return None
    return got if got.num_rows == hi - lo and pc.all(pc.match_substring_regex(block, _FAST)).as_py() else None


def _bisect(raw: pa.Array, lo: int, hi: int, parts: list[tuple[int, int, pa.Table]], bad: list[int]) -> None:
    """Split a failing block until its parts load, or are small enough to be diagnosed one by one."""
    if hi - lo <= LEAF:
        bad.extend(range(lo, hi))
        return
    mid = (lo + hi) // 2
    for a, z in ((lo, mid), (mid, hi)):
        got = _load_block(raw, a, z) if z - a > LEAF else None
        if got is None:
            _bisect(raw, a, z, parts, bad)
        else:
            parts.append((a, z, got))


def _csv_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size, dirty = START, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        raw = b.column("raw_line")
        parts: list[tuple[int, int, pa.Table]] = []
        strict: list[int] = []  # records of small failing blocks, good ones among them
        lo = 0
        while lo < n:
            hi = min(lo + size, n)
            got = _load_block(raw, lo, hi)
            if got is None:
                _bisect(raw, lo, hi, parts, strict)
                dirty = dirty + 1 if size == SMALLEST else 0
                size = max(size // 2, SMALLEST)
                if dirty > 1:
                    lo, hi = hi, min(hi + min(SMALLEST << dirty, LARGEST), n)
                    strict.extend(range(lo, hi))
            else:
                parts.append((lo, hi, got))
                size, dirty = min(size * 2, LARGEST), 0
            lo = hi
        records = raw.take(pa.array(strict, pa.int64())).to_pylist()
        rows = [diagnose(r) for r in records]
        cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())]
        cols += [pa.array([r[2][k] if r[2] else None for r in rows], t) for k, t in enumerate(_TYPES.values())]
        tables = [pa.table([pa.nulls(z - a, pa.string()), pa.nulls(z - a, pa.string()), *t.columns], schema=_SCHEMA) for a, z, t in parts]
        t = pa.concat_tables([*tables, pa.table(cols, schema=_SCHEMA)]).combine_chunks()
        order = [i for a, z, _ in parts for i in range(a, z)] + strict
        t = t.set_column(t.schema.get_field_index("observed_at"), "observed_at", t.column("observed_at").cast(pa.timestamp("us", tz="UTC")))
        keys = [b.column(c).take(pa.array(order, pa.int64())) for c in ("raw_id", "file_name", "line_no")]
        yield from pa.table([*keys, *t.columns], names=["raw_id", "file_name", "line_no", *t.column_names]).to_batches()


def load_csv_records(raw: DataFrame) -> DataFrame:
    """Every record of raw(raw_id, file_name, line_no, raw_line): typed columns where reason is null, else the reason it fails."""
    return raw.select("raw_id", "file_name", "line_no", "raw_line").mapInArrow(_csv_records, RECORDS)


# ---- reports ---------------------------------------------------------------------------------------------------------------
def failing_lines(runs: DataFrame, raw: DataFrame) -> DataFrame:
    a = load_json_lines(runs).where("NOT ok").select(F.lit("runs").alias("origin"), F.col("run_id").alias("row_id"), "line_no", F.lit("json").alias("reason")).distinct()
    b = load_csv_records(raw).where("reason IS NOT NULL").select(F.lit("raw_coverage").alias("origin"), F.col("raw_id").alias("row_id"), "line_no", "reason")
    return a.unionByName(b)


def run_status(runs: DataFrame) -> DataFrame:
    """Per run with any line: events and bad lines as they are, beside the recorded status and count."""
    once = load_json_lines(runs).select("run_id", "line_no", "ok").distinct()
    real = once.groupBy("run_id").agg(F.count_if("ok").alias("events"), F.count_if(~F.col("ok")).alias("bad_lines"))
    said = runs.groupBy("run_id").agg(F.max("stream_parse_status").alias("recorded_status"), F.max("invalid_json_line_count").alias("recorded_bad_lines"))
    status = F.when(F.col("bad_lines") > 0, "invalid-json").when(F.col("events") > 0, "complete").otherwise("no-json-events")
    out = said.join(real, said["run_id"].eqNullSafe(real["run_id"]), "left").drop(real["run_id"])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    out = out.select("run_id", zero("events"), zero("bad_lines"), "recorded_status", "recorded_bad_lines").withColumn("status", status)
    return out.withColumn("agrees", F.coalesce((F.col("bad_lines") == F.col("recorded_bad_lines")) & (F.col("status") == F.col("recorded_status")), F.lit(False)))
