"""Headers of files whose fields drift: one table with steady fields, and every change reported.

Files are sorted over the cluster by track and time. A first pass sums up, per partition and track,
which fields were present last, what was known of each (type and value sketch) and under what name
each began; these sums, as many as partitions and tracks that meet, are folded into the state with
which each partition starts; a second pass compares every file with the one before it and is
repeated where a partition ends otherwise than the next one was made to start. Fields that vanish and fields
that appear are matched as a bipartite assignment over type, value sketch and name.

Defined results
- a header that is null, cut off or no JSON object is passed over
- several deliveries of a file: the first readable one counts
- the first readable file of a track has no changes; rows without track, time or file are left out
- null has no type: it neither retypes nor forgets a type
- a field that returns after it was removed is added again, its type is known anew
- a table without readable rows gives empty results
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.ordering import sorted_runs
from tessella.session import cut

#: Weights of contents and name in the likeness of two fields, and the least likeness of a rename.
CONTENT_WEIGHT, NAME_WEIGHT, LEAST = 0.6, 0.4, 0.36
#: Where contents tell nothing (booleans, nulls), names must be at least this alike.
LEAST_NAME = 0.3
#: The likeness of two fields of one type of which neither contents nor names tell much: truth
#: values, and texts or lists that change from file to file anyway or share a part.
WEAK, SHARED, FEW = 0.15, 0.2, 3
#: Distinct field names one table may have.
MAX_FIELDS = 2_000

CHANGE = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("track", T.StringType()),
        T.StructField("field_name", T.StringType()),
        T.StructField("change_kind", T.StringType()),
        T.StructField("old_name", T.StringType()),
        T.StructField("old_type", T.StringType()),
        T.StructField("new_type", T.StringType()),
    ]
)


def kind_of(v: object) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "object"


def _words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)]


def name_likeness(a: str, b: str) -> float:
    """Share of the words that two names have in common; a short word may abbreviate."""
    x, y = _words(a), _words(b)
    if x == y:
        return 1.0

    def same(u: str, v: str) -> bool:
        short, long = sorted((u, v), key=len)
        return u == v or (len(short) >= 2 and long.startswith(short)) or (len(short) >= 6 and short[:6] == long[:6])

    hits = sum(any(same(u, v) for v in y) for u in x)
    return 2 * hits / (len(x) + len(y)) if hits <= min(len(x), len(y)) else 1.0


def sketch(old: dict | None, v: object) -> dict:
    """What is known of a field: type, last value, and for numbers the range so far."""
    kind = kind_of(v)
    if kind is None:
        return old or {"type": None}
    s = {"type": kind, "last": v, "seen": 1, "varies": False}
    if old and old.get("type") == kind:
        s |= {"seen": old["seen"] + 1, "varies": old["varies"] or old["last"] != v}
    if kind == "number" and math.isfinite(v):
        lo, hi = (old["lo"], old["hi"]) if old and old.get("type") == "number" and "lo" in old else (v, v)
        s |= {"lo": min(lo, v), "hi": max(hi, v)}
    return s


def as_number(text: str) -> float | None:
    try:
        return float(text.replace(",", "."))
    except ValueError:
        return None


def content_likeness(s: dict, v: object) -> float | None:
    """How well a value goes on from a sketch; None: nothing can be told."""
    kind = kind_of(v)
    if kind is None or s.get("type") is None or kind == "boolean":
        return None
    last = s["last"]
    if kind == "array" and len(v) == 1 and len(last) == 1 and kind_of(v[0]) == kind_of(last[0]) is not None:
        return content_likeness(sketch(None, last[0]), v[0])
    if kind == "string":
        x, y = as_number(last), as_number(v)
        if x is not None and y is not None:
            return content_likeness(sketch(None, x), y)
        if {last.casefold(), v.casefold()} <= {"true", "false", "yes", "no"}:
            return None
    if kind == "number":
        if "lo" not in s or not math.isfinite(v):
            return None
        lo, hi = s["lo"], s["hi"]
        if v == 0 or lo <= 0:
            return 1.0 if lo <= v <= hi else 0.3
        return math.exp(-max(0.0, math.log(lo / 1.5 / v) if v > 0 else 9.0, math.log(v / hi / 1.5)))
    if kind == "string":
        if last.casefold() == v.casefold():
            return 1.0
        x, y = set(re.findall(r"\w+", last.casefold())), set(re.findall(r"\w+", v.casefold()))
    elif kind == "array":
        x, y = ({json.dumps(e, sort_keys=True).casefold() for e in z} for z in (last, v))
    else:
        x, y = set(last), set(v)
    return len(x & y) / len(x | y) if x | y else 1.0


def likeness(old_name: str, s: dict, name: str, v: object) -> float:
    """0 where a rename is ruled out."""
    if kind_of(v) is not None and s.get("type") is not None and kind_of(v) != s["type"]:
        return 0.0
    names, contents = name_likeness(old_name, name), content_likeness(s, v)
    if contents is None:
        if names >= LEAST_NAME:
            return 0.5 + names / 2
        return WEAK if kind_of(v) is not None and s.get("type") is not None else 0.0
    score = CONTENT_WEIGHT * contents + NAME_WEIGHT * names
    if score >= LEAST:
        return score
    # what stayed the same in every file so far would go on; what varies may be anything
    return WEAK if s["type"] != "number" and (contents >= SHARED or s["varies"] or s["seen"] < FEW) else 0.0


def assign(gain: list[list[float]]) -> list[tuple[int, int]]:
    """The pairs of a matching with the greatest total gain (Hungarian method); gains of 0 don't pair."""
    rows, cols = len(gain), len(gain[0]) if gain else 0
    n = max(rows, cols)
    if not rows or not cols:
        return []
    cost = [[-(gain[i][j] if i < rows and j < cols else 0.0) for j in range(n)] for i in range(n)]
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], math.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, n + 1) if match[j] <= rows and j <= cols and gain[match[j] - 1][j - 1] > 0]


def step(state: dict | None, header: dict) -> tuple[dict, list[tuple]]:
    """The state after a file and its changes (field, kind, old name, old type, new type)."""
    if state is None:
        return {"present": sorted(header), "known": {k: sketch(None, v) for k, v in header.items()}}, []
    known, before = state["known"], set(state["present"])
    changes: list[tuple] = []
    gone, new = sorted(before - set(header)), sorted(set(header) - before)
    pairs = assign([[likeness(a, known[a], b, header[b]) for b in new] for a in gone])
    for i, j in pairs:
        changes.append((new[j], "renamed", gone[i], known[gone[i]]["type"], kind_of(header[new[j]])))
        known[new[j]] = known[gone[i]]
    kept = {new[j] for _, j in pairs}
    for b in new:
        if b not in kept:
            changes.append((b, "added", None, None, kind_of(header[b])))
            known.pop(b, None)
    for a in {*gone} - {gone[i] for i, _ in pairs}:
        changes.append((a, "removed", None, known[a]["type"], None))
    for k, v in header.items():
        kind, old = kind_of(v), known.get(k)
        if k in before and kind and old and old["type"] and kind != old["type"]:
            changes.append((k, "retyped", None, old["type"], kind))
        known[k] = sketch(old, v)
    return {"present": sorted(header), "known": {k: known[k] for k in header}}, changes


def dumped(state: dict) -> str:
    return json.dumps(state, sort_keys=True)


def joined(carry: dict, first: dict, own: dict, origin: dict[str, str | None]) -> dict:
    """The state after a partition that went on from `carry`: what was known before is added to what
    the partition knows of a field (own), which in the partition's first file was named origin[field]."""
    known, _ = step(carry, first)
    for k, x in own["known"].items():
        c = known["known"].get(origin.get(k)) if origin.get(k) is not None else None
        if c is None or c["type"] is None:
            continue
        if x["type"] is None:
            own["known"][k] = c
        elif x["type"] == c["type"]:
            # both have seen the first file
            x |= {"seen": c["seen"] + x["seen"] - (first[origin[k]] is not None), "varies": c["varies"] or x["varies"] or c["last"] != x["last"]}
            if "lo" in c:
                x |= {"lo": min(c["lo"], x.get("lo", c["lo"])), "hi": max(c["hi"], x.get("hi", c["hi"]))}
    return own


def load(header: str | None) -> dict | None:
    try:
        h = json.loads(header)
    except (TypeError, ValueError, RecursionError):
        return None
    return h if isinstance(h, dict) else None


def readable_files(records: DataFrame) -> DataFrame:
    """One row per file with a readable header: the first such delivery."""

    @F.pandas_udf(T.BooleanType())
    def readable(h: pd.Series) -> pd.Series:
        return h.map(lambda x: load(x) is not None)

    good = records.filter(F.col("track").isNotNull() & F.col("written_at").isNotNull() & F.col("file_id").isNotNull() & F.col("header").isNotNull()).filter(readable("header"))
    first = good.groupBy("file_id").agg(F.min(F.struct("received_at", "record_id", "track", "written_at", "file_name", "header")).alias("_f"))
    return first.select("file_id", "_f.track", "_f.written_at", "_f.file_name", "_f.header")


def changes(records: DataFrame) -> DataFrame:
    """Every change of a top-level field against the preceding readable file of the track."""
    runs = sorted_runs(readable_files(records).select("track", "written_at", "file_id", "header"), ["track"], ["written_at", "file_id"], in_place=True)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the first file, the last file's fields, and of each field what the partition knows of it
        pid, track, state, first, origin, out = None, None, None, None, {}, []
        for pdf in batches:
            for p, t, h in zip(pdf["_pid"], pdf["track"], pdf["header"]):
                header = load(h)
                if t != track:
                    if track is not None:
                        out.append((pid, track, first, dumped(state), json.dumps(origin)))
                    pid, track, state, first, origin = p, t, None, h, {k: k for k in header}
                state, found = step(state, header)
                was = {c[0]: origin.get(c[2]) for c in found if c[1] in ("renamed", "added")}
                origin = {k: was[k] if k in was else origin.get(k) for k in header}
        if track is not None:
            out.append((pid, track, first, dumped(state), json.dumps(origin)))
        yield pd.DataFrame(out, columns=["_pid", "track", "first", "state", "origin"])

    partial = runs.select("_pid", "track", "header").mapInPandas(sums, "_pid int, track string, first string, state string, origin string")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, carry = [], None
        for p, t, first, s, origin in sorted(pdf[["_pid", "track", "first", "state", "origin"]].itertuples(index=False)):
            own = json.loads(s)
            if carry is not None:
                out.append((p, t, carry))
                own = joined(json.loads(carry), load(first), own, json.loads(origin))
            carry = dumped(own)
        return pd.DataFrame(out, columns=["_pid", "track", "state"])

    start = cut(partial.groupBy("track").applyInPandas(fold, "_pid int, track string, state string"))

    def compare(key: tuple, files: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        begin = dict(zip(start["track"], start["state"]))
        out, track, state = [], None, None
        end = lambda: (None, track, *[None] * (len(CHANGE) - 2), int(key[0]), dumped(state))
        for t, _, f, h in files.sort_values(["track", "written_at", "file_id"])[["track", "written_at", "file_id", "header"]].itertuples(index=False):
            if t != track:
                if track is not None:
                    out.append(end())
                track, state = t, json.loads(begin[t]) if t in begin else None
            state, found = step(state, load(h))
            out += [(f, t, *c, None, None) for c in found]
        if track is not None:
            out.append(end())
        return pd.DataFrame(out, columns=[*CHANGE.names, "_pid", "_state"]).astype({"file_id": "Int64", "_pid": "Int32"})

    compared = T.StructType([*CHANGE.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_state", T.StringType())])
    before = Window.partitionBy("track").orderBy("_pid")
    while True:
        every = cut(runs.drop("_end").groupBy("_pid").cogroup(start.groupBy("_pid")).applyInPandas(compare, compared))
        # as many rows as partitions and tracks that meet; the first partition of a track is right,
        # so each round makes one more right, and mostly the first round finds all so
        ends = every.filter(F.col("_state").isNotNull()).select("_pid", "track", F.lag("_state").over(before).alias("state")).filter(F.col("state").isNotNull())
        if ends.join(start, ["_pid", "track", "state"], "left_anti").isEmpty():
            return every.filter(F.col("_state").isNull()).select(*CHANGE.names)
        start = cut(ends)


def steady_names(found: DataFrame, names: DataFrame) -> dict[str, list[str]]:
    """Canonical field -> all its names, the most used first. names: (field_name, files). These are
    field names, not data: more than MAX_FIELDS of them are an error."""
    use = {r[0]: r[1] for r in names.limit(MAX_FIELDS + 1).collect()}
    edges = found.filter(F.col("change_kind") == "renamed").groupBy("old_name", "field_name").count().limit(MAX_FIELDS**2).collect()
    if len(use) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} field names")
    parent = {n: n for n in use}

    def top(n: str) -> str:
        while parent[n] != n:
            n = parent[n]
        return n

    for e in edges:
        if e.old_name in parent and e.field_name in parent:
            parent[top(e.old_name)] = top(e.field_name)
    groups: dict[str, list[str]] = {}
    for n in sorted(use, key=lambda n: (-use[n], n)):
        groups.setdefault(top(n), []).append(n)
    return {g[0]: g for g in groups.values()}


def _as_array(v: object) -> list[str]:
    if isinstance(v, str):
        v = [x.strip() for x in re.split(r"[;,]", v)]
    if isinstance(v, dict):
        v = [v[k] for k in sorted(v, key=lambda k: (len(k), k))]
    return [x if isinstance(x, str) else json.dumps(x) for x in (v if isinstance(v, list) else [v])]


def convert(v: object, kind: str) -> object:
    """A value of any of a field's types as its main type; None where it can't be."""
    if v is None:
        return None
    if kind == "array":
        return _as_array(v)
    if isinstance(v, list) and len(v) == 1:
        v = v[0]
    if kind == "number":
        try:
            return float(v.replace(",", ".")) if isinstance(v, str) else float(v)
        except (ValueError, TypeError, OverflowError):
            return None
    if kind == "boolean":
        if isinstance(v, str):
            return {"true": True, "false": False, "1": True, "0": False, "yes": True, "no": False}.get(v.strip().lower())
        return bool(v) if isinstance(v, (bool, int, float)) else None
    if kind == "object":
        return v if isinstance(v, str) else json.dumps(v, sort_keys=True)
    return v if isinstance(v, str) else json.dumps(v, sort_keys=True)


SQL_TYPES = {"number": T.DoubleType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.StringType()), "object": T.StringType(), "string": T.StringType()}


def unified(records: DataFrame) -> DataFrame:
    """One row per readable file: file_id, track, written_at and one column per steady field, typed
    by the type most files give it; earlier and later names of a field are one column."""
    files = readable_files(records)

    def fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, kind_of(v)) for h in pdf["header"] for k, v in load(h).items()]
            yield pd.DataFrame(rows, columns=["field_name", "kind"])

    used = files.select("header").mapInPandas(fields, "field_name string, kind string").groupBy("field_name", "kind").agg(F.count("*").alias("files"))
    counts = used.limit(MAX_FIELDS * 6).collect()
    groups = steady_names(changes(records), used.groupBy("field_name").agg(F.sum("files")))
    kinds = {}
    for main, names in groups.items():
        per: dict[str, int] = {}
        for r in counts:
            if r.field_name in names and r.kind:
                per[r.kind] = per.get(r.kind, 0) + r.files
        kinds[main] = max(sorted(per), key=per.get) if per else "string"
    mains = sorted(groups)
    schema = T.StructType([f for f in files.schema.fields if f.name in ("file_id", "track", "written_at")] + [T.StructField(m, SQL_TYPES[kinds[m]]) for m in mains])

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["file_id", "track", "written_at"]].copy()
            heads = [load(h) for h in pdf["header"]]
            for m in mains:
                out[m] = pd.Series([next((convert(h[n], kinds[m]) for n in groups[m] if h.get(n) is not None), None) for h in heads], index=out.index, dtype=object)
            yield out

    return files.mapInPandas(table, schema)
