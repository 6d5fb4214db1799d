"""Problem 4: schemas that drift between files.

The header of every file (its field paths and their types) is read in parallel by one map over the files. Headers are folded in order
of `written_at` within each feed, giving the ordered differences; all headers of a producer are joined in a type-promotion lattice,
giving the union schema to which every file is cast.

A feed of more than CHUNK files is cut into stretches of about equal numbers of files, in order of time, that are folded side by side:
a first fold gives each stretch's end state (types of nulls that reach back before the stretch stay symbolic, and stand for the fields
below them too), the end states are chained per feed, and each stretch is folded again from the state before it. So no feed is a unit of
work. Where an end state could depend on what is symbolic (a null field that appears while others are unknown, which may be a renaming),
the feed is folded in one go instead, as a stream over its sorted headers.

Cases: a payload that is null or no JSON object has no header and is passed over, as if the file had not been written; repeats of an
artifact_id count once; files of equal `written_at` are ordered by artifact_id; a null has no type and keeps the last known one, the
fields below a null object stay as they were; a field of unknown type (always null so far) is never retyped and may be renamed to or
from any type; the first file of a feed has no changes; an empty table gives empty results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strict_json import loads
from ..plans.session import lookup, materialize

CHUNK = 5_000
#: most stretches of a feed
STRETCHES = 1_000
#: most columns a producer's union schema may have
MAX_COLUMNS = 10_000
SEP = "\x1f"
HEADER = "artifact_id bigint, feed_id bigint, producer string, written_at timestamp, header string"
CHANGES = "artifact_id bigint, change_kind string, old_field string, new_field string"


def contract(fields: DataFrame) -> dict[str, dict[str, list[str]]]:
    """producer -> paths of maps and of optional fields, from contract_fields (a table of fixed size)."""
    out: dict[str, dict[str, list[str]]] = {}
    rows = fields.where("json_type = 'map' OR is_optional").select("producer", "field_path", "json_type", "is_optional").limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError("contract_fields is larger than a contract may be")
    for r in rows:
        own = out.setdefault(r.producer, {"map": [], "optional": []})
        for kind, hit in (("map", r.json_type == "map"), ("optional", r.is_optional)):
            if hit:
                own[kind].append(r.field_path.replace(".", SEP))
    return out


def header_of(payload: str | None, maps: frozenset[str]) -> dict[str, str | None] | None:
    """path -> type (None for null) of every field of a JSON object; what lies in arrays and maps is data."""
    try:
        top = loads(payload) if payload else None
    except ValueError:
        return None
    if not isinstance(top, dict):
        return None
    out: dict[str, str | None] = {}
    stack = [("", top)]
    while stack:
        prefix, node = stack.pop()
        for k, v in node.items():
            path = prefix + k
            if v is None:
                out[path] = None
            elif v is True or v is False:
                out[path] = "boolean"
            elif isinstance(v, str):
                out[path] = "string"
            elif isinstance(v, list):
                out[path] = "array"
            elif isinstance(v, dict):
                out[path] = "object"
                if path not in maps:
                    stack.append((path + SEP, v))
            else:
                out[path] = "number"
    return out


def read_headers(files: DataFrame, rules: dict) -> DataFrame:
    maps = {p: frozenset(r["map"]) for p, r in rules.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for producer, payload in zip(b.column("producer").to_pylist(), b.column("payload").to_pylist()):
                h = header_of(payload, maps.get(producer, frozenset()))
                out.append(None if h is None else json.dumps(h, sort_keys=True))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("artifact_id", "feed_id", "producer", "written_at")), pa.array(out, pa.string())], names=["artifact_id", "feed_id", "producer", "written_at", "header"])

    return files.select("artifact_id", "feed_id", "producer", "written_at", "payload").mapInArrow(run, HEADER).where(F.col("header").isNotNull())


_WORD = re.compile(r"[_\-]|(?=[A-Z])")


def words(name: str) -> frozenset[str]:
    return frozenset(w for w in (x.lower().removesuffix("s") for x in _WORD.split(name)) if w)


def _under(path: str, tops: set[str]) -> bool:
    while SEP in path:
        path = path.rpartition(SEP)[0]
        if path in tops:
            return True
    return False


def step(prev: dict[str, str | None] | None, raw: dict[str, str | None], optional: frozenset[str]) -> tuple[list[tuple[str, str, str]], dict[str, str | None]]:
    """Changes from the state before (None: first file) to a file's header, and the state after. A type '@path' stands for the
    type that the path had before the first file."""
    if prev is None:
        return [], {p: t if t is not None else f"@{p}" for p, t in raw.items()}
    state: dict[str, str | None] = {p: t if t is not None else prev.get(p) for p, t in raw.items()}
    hollow = {p for p, t in raw.items() if t is None and prev.get(p) == "object"}
    if hollow:
        state.update({p: t for p, t in prev.items() if p not in state and _under(p, hollow)})
    known = lambda t: t is not None and t[0] != "@"
    retyped = {p for p, t in state.items() if p in prev and known(t) and known(prev[p]) and t != prev[p]}
    gone = {p for p in prev if p not in state}
    new = {p for p in state if p not in prev}
    gone = [p for p in gone if p not in optional and not _under(p, gone | retyped)]
    new = [p for p in new if p not in optional and not _under(p, new | retyped)]
    retyped = {p for p in retyped if not _under(p, retyped)}
    pairs = []
    for g in gone:
        parent, _, last = g.rpartition(SEP)
        mine = words(last)
        for q in new:
            other, _, name = q.rpartition(SEP)
            if other == parent and (prev[g] == state[q] or not known(prev[g]) or not known(state[q])):
                theirs = words(name)
                if mine & theirs:
                    pairs.append((-len(mine & theirs) / len(mine | theirs), g, q))
    out, used = [("retyped", p, p) for p in retyped], set()
    for _, g, q in sorted(pairs):
        if g not in used and q not in used:
            used |= {g, q}
            out.append(("renamed", g, q))
            if not known(state[q]):
                state[q] = prev[g]
    out += [("removed", p, "") for p in gone if p not in used]
    out += [("added", "", p) for p in new if p not in used]
    return sorted(out), state


def _ordered(df: DataFrame) -> DataFrame:
    return df.repartition("feed_id", "chunk").sortWithinPartitions("feed_id", "chunk", "written_at", "artifact_id")


def _fold(rules: dict, summarise: bool):
    """Stream rows sorted by feed, stretch and time; one state at a time."""
    optional = {p: frozenset(r["optional"]) for p, r in rules.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, last_id, depends, first = None, None, None, False, None

        def summary():
            cols = (pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([first[0]], pa.string()), pa.array([first[1]], pa.string()), pa.array([json.dumps(state)], pa.string()), pa.array([depends], pa.bool_()))
            return pa.RecordBatch.from_arrays(list(cols), names=[c.split()[0] for c in ENDS.split(", ")])

        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            cols = [b.column(c).to_pylist() for c in ("feed_id", "chunk", "artifact_id", "producer", "header")]
            carries = b.column("carry").to_pylist() if "carry" in b.schema.names else [None] * b.num_rows
            for feed, part, artifact, producer, header, carry in zip(*cols, carries):
                if (feed, part) != key:
                    if summarise and key is not None:
                        yield summary()
                    key, last_id, depends, first = (feed, part), None, False, (producer, header)
                    state = json.loads(carry) if carry else None
                if artifact is not None and artifact == last_id:
                    continue  # delivered again
                last_id = artifact
                raw = json.loads(header)
                if summarise and state is not None:
                    depends = depends or is_open(state, raw)
                changes, state = step(state, raw, optional.get(producer, frozenset()))
                for kind, old, new in changes:
                    for c, x in zip(out, (artifact, kind, old.replace(SEP, "."), new.replace(SEP, "."))):
                        c.append(x)
            if not summarise:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["artifact_id", "change_kind", "old_field", "new_field"])
        if summarise and key is not None:
            yield summary()

    return run


def is_open(state: dict[str, str | None], raw: dict[str, str | None]) -> bool:
    """Whether the state after a file may depend on what is symbolic: a null field appears, which may be a renaming of one that is."""
    return any(t is None and p not in state for p, t in raw.items()) and any(t is not None and t[0] == "@" for t in state.values())


def follow(before: dict[str, str | None] | None, first: dict[str, str | None], end: dict[str, str | None], optional: frozenset[str]) -> dict[str, str | None]:
    """The state after a stretch, from the state before it, the header of its first file and its own end state."""
    _, start = step(before, first, optional)
    out = {p: start.get(t[1:], t) if isinstance(t, str) and t[0] == "@" else t for p, t in end.items()}
    # an object that was null throughout keeps the fields below it
    hollow = {p for p, t in end.items() if t == f"@{p}" and start.get(p) == "object"}
    if hollow:
        out.update({p: t for p, t in start.items() if p not in out and _under(p, hollow)})
    return out


ENDS = "feed_id bigint, chunk int, producer string, first string, state string, depends boolean"


def _chain(rules: dict):
    optional = {p: frozenset(r["optional"]) for p, r in rules.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Per feed: the state before each stretch, from those before it."""
        pdf = pdf.sort_values("chunk")
        before, out = None, []
        for producer, first, end in zip(pdf["producer"], pdf["first"], pdf["state"]):
            out.append(None if before is None else json.dumps(before))
            before = follow(before, json.loads(first), json.loads(end), optional.get(producer, frozenset()))
        return pd.DataFrame({"feed_id": pdf["feed_id"], "chunk": pdf["chunk"], "carry": out})

    return run


def schema_changes(files: DataFrame, fields: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every change, with the file where it first shows."""
    rules = contract(fields)
    headers = read_headers(files, rules)
    # narrow scan: only ids and times
    sizes = files.groupBy("feed_id").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    n_hot, most = sizes.agg(F.count("*"), F.max("n")).first()
    if not n_hot:
        return _ordered(headers.withColumn("chunk", F.lit(0))).mapInArrow(_fold(rules, False), CHANGES)
    # cuts of about equal ranks: a sketch per hot feed, combined before the shuffle
    k = min(STRETCHES, -(-most // chunk))
    hot = lookup(files.select("feed_id", "written_at"), sizes, ["feed_id"], n_hot)
    cuts = hot.groupBy("feed_id").agg(F.percentile_approx(F.unix_micros("written_at"), [i / k for i in range(1, k)], 20 * k).alias("cuts"))
    cut = lookup(headers, materialize(cuts, "drift-cuts"), ["feed_id"], n_hot, "left")
    part = F.size(F.filter("cuts", lambda c: c < F.unix_micros("written_at")))
    cut = materialize(cut.withColumn("chunk", F.when(F.col("cuts").isNotNull(), part).otherwise(0)).withColumn("big", F.col("cuts").isNotNull()).drop("cuts"), "drift-headers")
    ends = materialize(_ordered(cut.where("big")).mapInArrow(_fold(rules, True), ENDS), "drift-ends")
    whole = ends.groupBy("feed_id").agg(F.bool_or("depends").alias("whole")).where("whole")
    cut = lookup(cut, whole, ["feed_id"], n_hot, "left").withColumn("chunk", F.when(F.col("whole"), 0).otherwise(F.col("chunk"))).drop("whole")
    ends = ends.join(whole.select(F.col("feed_id").alias("w")), F.col("feed_id").eqNullSafe(F.col("w")), "left_anti")
    carry = ends.groupBy("feed_id").applyInPandas(_chain(rules), "feed_id bigint, chunk int, carry string")
    return _ordered(cut.join(carry, (cut["feed_id"].eqNullSafe(carry["feed_id"])) & (cut["chunk"] == carry["chunk"]), "left").drop(carry["feed_id"], carry["chunk"])).mapInArrow(_fold(rules, False), CHANGES)


# ---- union schema -----------------------------------------------------------------------------------------------------------
def promote(types: frozenset[str]) -> str:
    """Join in the lattice null < boolean, number, array, object < string: what differs is text."""
    types = types - {"null"}
    return next(iter(types)) if len(types) == 1 else "string" if types else "null"


def union_schema(headers: DataFrame, producer: str) -> dict[str, str]:
    """path -> type over all files of a producer."""
    pairs = headers.where(F.col("producer") == producer).select(F.explode(F.from_json("header", "map<string,string>")).alias("path", "type"))
    found = pairs.groupBy("path").agg(F.collect_set(F.coalesce("type", F.lit("null"))).alias("types")).limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"{producer} has more than {MAX_COLUMNS} fields: keys of a map are read as fields")
    return {r.path: promote(frozenset(r.types)) for r in sorted(found, key=lambda r: r.path)}


def _struct(paths: dict[str, str], prefix: str = "") -> T.StructType:
    fields = []
    for p, t in paths.items():
        if p.startswith(prefix) and SEP not in (name := p[len(prefix) :]):
            below = t == "object" and any(q.startswith(p + SEP) for q in paths)
            fields.append(T.StructField(name, _struct(paths, p + SEP) if below else T.StringType()))
    return T.StructType(fields)


def consistent_table(files: DataFrame, fields: DataFrame, producer: str) -> DataFrame:
    """All files of a producer under the union of their schemas: number is double, boolean is boolean, all else (and every
    field whose type drifts) is text, JSON text for arrays, maps and objects. Columns are named by path, '__' between levels."""
    rules = contract(fields)
    own = files.where(F.col("producer") == producer)
    paths = union_schema(read_headers(own, rules), producer)
    keys = ["artifact_id", "feed_id", "repo", "file_name", "schema_version", "written_at"]
    once = own.select(*keys, "payload").distinct().where(F.col("payload").isNotNull())
    schema = _struct(paths)
    out = once.withColumn("p", F.from_json("payload", schema)) if schema else once
    cols, seen = [], set(keys)
    for p, t in paths.items():
        ancestors = [p[: i] for i, c in enumerate(p) if c == SEP]
        if any(paths.get(a) != "object" for a in ancestors) or (t == "object" and any(q.startswith(p + SEP) for q in paths)):
            continue  # part of a column of text, or only the parent of columns
        name = p.replace(SEP, "__")
        while name.lower() in {s.lower() for s in seen}:
            name += "_"
        seen.add(name)
        value = F.col("p")
        for part in p.split(SEP):
            value = value.getField(part)
        cols.append((value.try_cast("double") if t == "number" else value.try_cast("boolean") if t == "boolean" else value).alias(name))
    return out.select(*keys, *cols)
