"""First behavioural divergence of two traces: a walk of both call trees in step, one trace pair per group."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions import values
from tracewise.functions.paths import CONTAINERS, QUOTED, SEGMENT
from tracewise.functions.scores import AT_RETURN
from tracewise.operators.scoring import time_limit
from tracewise.schemas import DIVERGENCE, EVENTS, PAIR_KEY
from tracewise.sources.scratch import stored


# Calls that are never entered because they draw at random, or because they only wrap another.
RANDOM = [
    "django.contrib.auth.base_user:AbstractBaseUser.set_password",
    "django.core.cache.backends.base:BaseCache.get_backend_timeout",
    "sphinx.util.logging:SphinxLoggerAdapter.log",
    "sphinx.environment:BuildEnvironment.__getstate__",
    "__init__:SphinxTransform.env",
    "tests.utils:create_server.<locals>.server",
    "xarray.tests:create_test_data",
]
WRAPPERS = [
    "sympy.multipledispatch.dispatcher:Dispatcher.__call__",
    "sympy.core.cache:__cacheit.<locals>.func_wrapper.<locals>.wrapper",
]


@dataclass
class Event:
    id: int
    type: str
    row: dict
    excluded: bool = False


@dataclass
class Block:
    name: str
    parent: Block | None
    depth: int
    patched: bool = False
    call: dict = field(default_factory=dict)
    raised: bool = False
    events: list[Event] = field(default_factory=list)
    callees: dict[int, Block] = field(default_factory=dict)
    at: int = -1

    def last_event(self) -> Event | None:
        """The return event, or the exception before it if the block raised."""
        if not self.events:
            return None
        return self.events[-2] if self.raised and len(self.events) > 1 else self.events[-1]

    def next(self) -> Event | None:
        if self.at < 0:
            last = self.last_event()
            self.at = self.events.index(last) if self.patched and last is not None else 0
        while self.at < len(self.events):
            event = self.events[self.at]
            self.at += 1
            if not (event.excluded and event.type == "Line"):
                return event
        return None


def tree(rows: list[dict]) -> tuple[Block | None, bool]:
    """Entry block of a trace in event order, and whether it has events on patch lines."""
    patched = {r["function_name"] for r in rows if r["excluded"]}
    top = Block("<module>", None, 0)
    now, entry = top, None
    for k, r in enumerate(rows):
        event = Event(r["event_id"], r["event_type"], r, bool(r["excluded"]))
        now.events.append(event)
        if event.type == "Function":
            callee = Block(r["function_name"], now, now.depth + 1, r["function_name"] in patched, call=r)
            now.callees[event.id] = callee
            if now is top and entry is None:
                entry = callee
            now = callee
        elif event.type == "Exception" and k + 1 < len(rows) and rows[k + 1]["event_type"] == "Return":
            now.raised = True
        elif event.type == "Return" and now.parent is not None:
            if now.raised and r.get("return_value") and _raised_type(now) == "StopIteration":
                now.raised = False
            now = now.parent
    return entry, bool(patched)


def _raised_type(block: Block) -> str | None:
    return next((e.row.get("exception_type") for e in reversed(block.events) if e.type == "Exception"), None)


def same_place(a: dict, b: dict) -> bool:
    """Whether two events match: same kind, function and statement."""
    return (a["event_type"], a["function_name"], a["statement"]) == (b["event_type"], b["function_name"], b["statement"])


#: What of an event is compared.
STATE = ("seen_variables", "return_value", "exception_type", "exception_value")


def _state(row: dict) -> dict:
    return {k: row.get(k) if k.startswith("exception") else values.parse(row.get(k) or "null") for k in STATE}


def state_diff(a: dict, b: dict, repo: str, limit: int | None) -> tuple[str, str] | None:
    """(kind, path) of a shallowest difference of two events' states. States of the same text, as most are, aren't parsed."""
    if all(a.get(k) == b.get(k) for k in STATE):
        return None
    try:
        found = list(values.difference(*(values.rounded(_state(x), 3) for x in (a, b)), unordered=values.unordered_fields(repo)))
    except ValueError:
        return None

    def depth(path: str) -> int:
        segments = re.findall(SEGMENT, path)
        return len(segments) - bool(segments and segments[0].strip("'\"") in CONTAINERS)

    kept = [(depth(p), p, k) for k, p, _, _ in found if limit is None or depth(p) <= limit]
    return min(kept)[2:0:-1] if kept else None


def _variables(row: dict, key: str) -> dict:
    found = values.parse(row.get(key) or "{}")
    return found if isinstance(found, dict) else {}


def view(row: dict, path: str) -> dict:
    """What of an event's state a difference shows: the differing variable on a line, else what the block returned or raised."""
    if row["event_type"] == "Line":
        name = variable_of(path)
        seen = _variables(row, "seen_variables")
        return {name: seen[name]} if name in seen else {}
    returned, raised = values.parse(row.get("return_value") or "null"), row.get("exception_type")
    out = {"__exception__": [raised, row.get("exception_value")], "__return__": returned}
    if raised is not None and returned is None:
        del out["__return__"]
    elif raised is None:
        del out["__exception__"]
    return out


def variable_of(path: str) -> str:
    """The second quoted key of a path."""
    names = re.findall(QUOTED, path)
    return names[1] if len(names) > 1 else ""


def _equal(a, b, digits: int = 5) -> bool:
    return next(values.difference(values.rounded(a, digits), values.rounded(b, digits)), None) is None


def _from_caller(views: list[dict], frames: list[dict]) -> bool:
    """Whether variables that differ are parameters of either side's call and have the values that the call gave them, so the difference came in with it. A value that is missing is None."""
    given = [_variables(f, "parameters") for f in frames]
    names = (views[0].keys() | views[1].keys()) & (given[0].keys() | given[1].keys())
    return bool(names) and all(_equal(v.get(n), g.get(n)) for n in names for v, g in zip(views, given, strict=True))


def walk(buggy: list[dict], patched: list[dict], agent: str, repo: str, limit: int, matches: Callable[[dict, dict], bool] = same_place) -> tuple | None:
    """(buggy row, patched row, kind, path, buggy call, seen_pmf) of the first divergence, or None. Parameters are those of the call that opened a block."""
    (x, px), (y, py) = tree(buggy), tree(patched)
    started = not (px and py)
    limit = limit if agent == "gold" else None
    while x is not None and y is not None:
        a, b = x.next(), y.next()
        if a is None or b is None:
            x, y = (x.parent, y.parent) if x.parent and y.parent else (None, None)
            continue
        started = started or x.patched or y.patched
        if x.name == y.name and matches(a.row, b.row):
            if a.type == "Function":
                p, q = x.callees[a.id], y.callees[b.id]
                started = started or p.patched or q.patched or p.name in WRAPPERS
                if p.name in RANDOM or p.name in WRAPPERS:
                    continue
                if p.patched and not p.raised and not q.raised and x.depth > 1:
                    continue
                x, y = p, q
                continue
            if not started:
                continue
            found = state_diff(a.row, b.row, repo, limit)
            if found is None:
                continue
            if a.type == b.type == "Line" and _from_caller([view(e.row, found[1]) for e in (a, b)], [x.call, y.call]):
                x, y = (x.parent, y.parent) if x.parent and y.parent else (None, None)
                continue
            return a.row, b.row, *found, x.call, bool(px and py)
        started = True
        a, b = x.last_event(), y.last_event()
        found = state_diff(a.row, b.row, repo, limit) if a and b else None
        if found is not None:
            return a.row, b.row, *found, x.call, bool(px and py)
        x, y = (x.parent, y.parent) if x.parent and y.parent else (None, None)
    return None


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """batch.to_pylist(), with texts and whole columns of nulls taken as columns, which is most of the time it takes."""

    def column(c: pa.Array) -> list:
        if c.null_count == len(c):
            return [None] * len(c)
        plain = pa.types.is_string(c.type) or not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_boolean(c.type))
        return c.to_numpy(zero_copy_only=False).tolist() if plain else c.to_pylist()

    return (dict(zip(batch.schema.names, row, strict=True)) for row in zip(*map(column, batch.columns), strict=True))


#: Where an event stands.
PLACE = ("filepath", "line_number", "function_name")


def line_count(rows: list[dict], event: int) -> int | None:
    """How many events other than calls a trace has up to an event at its place; None for none. As with_counts has it."""
    at = next(r for r in rows if r["event_id"] == event)
    n = sum(r["event_id"] is not None and r["event_id"] <= event and r["event_type"] not in ("Function", None) and all(r[c] == at[c] for c in PLACE) for r in rows)
    return n or None


def first_divergence(events: DataFrame, limit: int = 3, matches: Callable[[dict, dict], bool] = same_place, seconds: float = 600.0, longer: dict[str, float] | None = None, most_events: int = 1_000_000, counts: bool = False) -> DataFrame:
    """Per (agent, instance, test) with both sides: the divergence, and a status.

    ok, empty, or error with its kind. Pairs are dealt out by their key and walked one after the
    other as they come by, each in one task. One that takes more than its seconds (longer: by
    instance) or has more than most_events is a row with error: time or error: size, and an
    oversized one is let go as soon as it is. events: EVENTS and excluded, shuffled once. counts: with
    the columns of with_counts, of the rows that are there anyway.
    """
    told = DIVERGENCE + ", buggy_line_count bigint, patched_line_count bigint" * counts
    names = [c.split()[0] for c in told.split(", ")]
    longer = longer or {}

    def walked(rows: tuple[list[dict], list[dict]], agent: str, instance: str) -> dict:
        found = walk(*rows, agent, str(instance).split("__")[0], limit, matches)
        if not found:
            return {"status": "empty"}
        a, b, kind, path, call, pmf = found
        ended = {"Return", "Exception"} & {a["event_type"], b["event_type"]}
        return {
            "status": "ok", "function_name": call.get("function_name") or "<module>", "file_path": b["filepath"], "buggy_event_id": a["event_id"], "patched_event_id": b["event_id"],
            "buggy_event_type": a["event_type"], "patched_event_type": b["event_type"], "buggy_statement": a["statement"], "patched_statement": b["statement"],
            "location": AT_RETURN if a["event_type"] in ("Return", "Exception") else a["statement"], "before_or_after": "after" if ended else "before",
            "buggy_lineno": a["line_number"], "patched_lineno": b["line_number"], "buggy_function_param": call.get("parameters"), "diff_kind": kind, "diff_path": path,
            "buggy_variables": values.dump(view(a, path)), "patched_variables": values.dump(view(b, path)), "seen_pmf": pmf,
        } | ({"buggy_line_count": line_count(rows[0], a["event_id"]), "patched_line_count": line_count(rows[1], b["event_id"])} if counts else {})

    def outcome(key: tuple, rows: tuple[list[dict], list[dict]]) -> dict:
        try:
            with time_limit(longer.get(key[1], seconds)):
                out = walked(rows, key[0], key[1])
        except TimeoutError:
            out = {"status": "error: time"}
        except (ValueError, KeyError, TypeError, RecursionError, MemoryError) as e:
            out = {"status": f"error: {type(e).__name__}"}
        return dict(zip(PAIR_KEY, key, strict=True)) | dict.fromkeys(names) | out

    def run(batches):
        now, rows, n = None, ([], []), 0

        def ended() -> list[dict]:
            if n > most_events:
                both = seen >= {"buggy", "patched"}
                return [dict(zip(PAIR_KEY, now, strict=True)) | dict.fromkeys(names) | {"status": "error: size"}] if both else []
            return [outcome(now, rows)] if all(rows) and None not in now else []

        for batch in batches:
            done = []
            for row in _rows(batch):
                key = tuple(row[c] for c in PAIR_KEY)
                if key != now:
                    if now is not None:
                        done += ended()
                    now, rows, n, seen = key, ([], []), 0, set()
                n += 1
                seen.add(row["side"])
                if n > most_events:
                    rows = ([], [])
                elif row["side"] in ("buggy", "patched"):
                    rows[row["side"] == "patched"].append(row)
            yield pa.RecordBatch.from_pylist(done, schema=kinds)
        if now is not None:
            yield pa.RecordBatch.from_pylist(ended(), schema=kinds)

    columns = f"agent string, instance_id string, test_id int, {told}"
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    kinds = pa.schema([(c.split()[0], arrow[c.split()[1]]) for c in columns.split(", ")])
    read = events.select(*(c.split()[0] for c in EVENTS.split(", ")), "excluded")
    return read.repartition(*PAIR_KEY).sortWithinPartitions(*PAIR_KEY, "event_id").mapInArrow(run, columns)


def first_useful(found: DataFrame) -> DataFrame:
    """Per (agent, instance) the divergence of the first test that has one; if none has, the first test's row."""
    w = Window.partitionBy("agent", "instance_id").orderBy(F.when(F.col("status") == "ok", 0).otherwise(1), "test_id")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_useful_in_waves(events: DataFrame, most_waves: int = 64, **how) -> DataFrame:
    """first_useful(first_divergence(events)), test by test: each wave walks the next test of what has no divergence yet.

    Later tests of solved instances aren't read where events are partitioned by the pair's key
    on disk, and aren't shuffled elsewhere. A wave's rows are written to the shared folder. As an
    error ends an instance's search only with its last test, so do all waves here. What is left
    after most_waves goes in one last wave.
    """
    side = F.col("side")
    both = events.groupBy(*PAIR_KEY).agg(F.bool_or(side == "buggy").alias("a"), F.bool_or(side == "patched").alias("b")).where("a and b")
    turn = F.row_number().over(Window.partitionBy("agent", "instance_id").orderBy("test_id"))
    tests = stored(both.select(*PAIR_KEY, turn.alias("_turn")), "tests")
    done, open_ = [], tests.select("agent", "instance_id").distinct()
    for wave in range(1, most_waves + 1):
        turn_ = F.col("_turn") == wave if wave < most_waves else F.col("_turn") >= wave
        asked = stored(tests.where(turn_).join(open_, ["agent", "instance_id"], "left_semi").select(*PAIR_KEY), "asked")
        if asked.isEmpty():
            break
        found = stored(first_divergence(events.join(asked, PAIR_KEY, "left_semi"), **how), "wave")
        done.append(found)
        open_ = asked.select("agent", "instance_id").distinct().join(found.where("status = 'ok'"), ["agent", "instance_id"], "left_anti")
    return first_useful(reduce(DataFrame.unionByName, done)) if done else first_useful(first_divergence(events, **how))


def with_counts(found: DataFrame, events: DataFrame) -> DataFrame:
    """found with buggy_line_count and patched_line_count: how many events other than calls had been at the event's line, file and function, itself included.

    Only events at the places that were picked take part. found is written first, as it is read
    for each side. Its files are small for their rows, so joins are to be merges: by its size Spark
    would gather all picked keys in the driver.
    """
    place = ["filepath", "line_number", "function_name"]
    out = found = stored(found, "found")
    for side in ("buggy", "patched"):
        picked = found.where("status = 'ok'").select(*PAIR_KEY, F.col(f"{side}_event_id").alias("event_id"))
        own = events.where(F.col("side") == side).select(*PAIR_KEY, "event_id", "event_type", *place)
        at = picked.hint("merge").join(own, [*PAIR_KEY, "event_id"]).select(*PAIR_KEY, F.col("event_id").alias("_last"), *(F.col(c).alias(f"_{c}") for c in place))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
        met = own.join(at.hint("merge"), PAIR_KEY).where((F.col("event_id") <= F.col("_last")) & (F.col("event_type") != "Function") & reduce(lambda x, y: x & y, same))
        counts = met.groupBy(*PAIR_KEY).agg(F.count("*").alias(f"{side}_line_count"))
        out = out.join(counts.hint("merge"), PAIR_KEY, "left")
    return out


def simplify_parameters(found: DataFrame, variables: int = 4, parameters: int = 3) -> DataFrame:
    """Serialised variables and parameters pruned to their depths."""
    out = found.withColumn("buggy_function_param", values.simplified(F.col("buggy_function_param"), parameters))
    return out.withColumns({c: values.simplified(F.col(c), variables) for c in ("buggy_variables", "patched_variables")})
