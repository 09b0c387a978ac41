"""The traversal language: parsed to steps, compiled to one lazy frame of distinct vertices."""

from __future__ import annotations

import json
import math
import re
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import triples as T


class TraversalError(ValueError):
    def __init__(self, message: str, position: int = 0):
        super().__init__(f"{message} at {position}")
        self.message, self.position = message, position


@dataclass(frozen=True)
class Step:
    kind: str
    args: tuple = ()
    children: tuple[tuple[Step, ...], ...] = ()


_TOKEN = re.compile(r'\s*(?:(?P<text>"(?:[^"\\]|\\.)*")|(?P<open>")|(?P<number>\d+)|(?P<name>[A-Za-z_]+)|(?P<op>>=|<=|>|<)|(?P<mark>[.(),]))', re.S)
_SETS = {"And": "and", "Or": "or", "Not": "not", "Difference": "not"}
_COMPARED = {"HasGt": ">", "HasGte": ">=", "HasLt": "<", "HasLte": "<="}


class Parser:
    """Recursive descent over ``g.Step(...).Step(...)``; morphisms are spliced in where they are followed."""

    def __init__(self, source: str, morphisms: dict[str, tuple[Step, ...]] | None = None):
        self.source, self.morphisms, self.tokens, at = source, morphisms or {}, [], 0
        while at < len(source.rstrip()):
            m = _TOKEN.match(source, at)
            if not m:
                raise TraversalError("Unexpected character", at)
            if m.lastgroup == "open":
                raise TraversalError("Unterminated string literal", m.start("open"))
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        if not self.tokens:
            raise TraversalError("Empty query", 0)
        self.tokens.append(("end", "", len(source)))
        self.at = 0

    def peek(self) -> tuple[str, str, int]:
        return self.tokens[self.at]

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        k, v, position = self.tokens[self.at]
        if (value is not None and v != value) or (kind is not None and k != kind):
            raise TraversalError(f"Expected {value or kind}", position)
        self.at += 1
        return v

    def text(self) -> str:
        return re.sub(r"\\(.)", r"\1", self.take(kind="text")[1:-1], flags=re.S)

    def whole(self) -> tuple[Step, ...]:
        steps = self.chain()
        if self.peek()[0] != "end":
            raise TraversalError("Unexpected input", self.peek()[2])
        return steps

    def chain(self) -> tuple[Step, ...]:
        self.take("g")
        steps: list[Step] = []
        while self.peek()[1] == ".":
            self.take(".")
            if self.peek()[0] == "end":  # a trailing dot
                break
            steps += self.step(bool(steps))
        if not steps:
            raise TraversalError("Expected a step", self.peek()[2])
        return tuple(steps)

    def step(self, later: bool) -> list[Step]:
        position = self.peek()[2]
        name = self.take(kind="name")
        self.take("(")
        if name == "V":
            if later:
                raise TraversalError("V must come first", position)
            out = [Step("vertex", (self.text(),))]
        elif name in ("Out", "In"):
            out = [Step(name.lower(), (self.text(),))]
        elif name == "Has":
            predicate, op = self.text(), "="
            self.take(",")
            if self.peek()[0] == "op":
                op = self.take()
                self.take(",")
            out = [Step("has", (predicate, op, self.text()))]
        elif name in _COMPARED:
            predicate = self.text()
            self.take(",")
            out = [Step("has", (predicate, _COMPARED[name], self.text()))]
        elif name in _SETS:
            children = [self.chain()]
            while self.peek()[1] == ",":
                self.take(",")
                children.append(self.chain())
            out = [Step(_SETS[name], (), tuple(children))]
        elif name in ("Limit", "GetLimit"):
            out = [Step("limit", (int(self.take(kind="number")),))]
        elif name == "Follow":
            name = self.text()
            if name not in self.morphisms:
                raise TraversalError(f"Unknown morphism '{name}'", position)
            out = list(self.morphisms[name])
        elif name == "Morphism":
            out = [Step("morphism", (self.text(),))]
        elif name in ("All", "Count"):
            out = [Step(name.lower())]
        else:
            raise TraversalError(f"Unknown method '{name}'", position)
        self.take(")")
        return out


def parse(source: str, morphisms: dict[str, tuple[Step, ...]] | None = None) -> tuple[Step, ...]:
    return Parser(source, morphisms).whole()


def predicates_of(steps: tuple[Step, ...]) -> set[str]:
    own = {s.args[0] for s in steps if s.kind in ("out", "in", "has")}
    return own.union(*(predicates_of(c) for s in steps for c in s.children))


@dataclass
class Stats:
    """Per predicate: triples and distinct subjects; estimates follow from these alone.

    Fixed values: 10 vertices for a filter and 5 a vertex for a step on a predicate without statistics, half the subjects for a range.
    """

    counts: dict[str, tuple[int, int]]

    @classmethod
    def of(cls, triples: DataFrame) -> Stats:
        return cls({r.p: (r.triple_count, r.distinct_subjects) for r in T.predicate_stats(triples).collect()})

    def has(self, predicate: str, op: str) -> int:
        if predicate not in self.counts:
            return 10
        total, subjects = self.counts[predicate]
        return max(1, math.ceil(total / max(1, subjects))) if op == "=" else max(1, subjects // 2)

    def hop(self, predicate: str, size: int) -> int:
        if predicate not in self.counts:
            return size * 5
        total, subjects = self.counts[predicate]
        return size * max(1, math.ceil(total / max(1, subjects)))

    def chain(self, steps: tuple[Step, ...]) -> int:
        size: int | None = None
        for s in steps:
            if s.kind == "vertex":
                size = 1
            elif s.kind in ("out", "in"):
                size = self.hop(s.args[0], size or 1)
            elif s.kind == "has":
                size = min(size or 1 << 62, self.has(*s.args[:2]))
            elif s.kind == "and":
                size = min([size or 1 << 62, *map(self.chain, s.children)])
            elif s.kind == "or":
                size = (size or 0) + sum(map(self.chain, s.children))
            elif s.kind == "not" and size is None:
                size = self.chain(s.children[0])
            elif s.kind == "limit":
                size = min(size or 1 << 62, s.args[0])
        return max(1, size or 1)


def optimise(steps: tuple[Step, ...], stats: Stats | None = None) -> tuple[Step, ...]:
    """Orders runs of Has and the children of And by estimated size, and turns And over a chain of Has alone into that chain.

    The rest (pushdown, pruning, pipelining) is Catalyst's.
    """
    out: list[Step] = []
    for s in steps:
        children = tuple(optimise(c, stats) for c in s.children)
        if s.kind == "and" and stats:
            children = tuple(sorted(children, key=stats.chain))
        if s.kind == "and" and len(children) == 1 and out and all(c.kind == "has" for c in children[0]):
            out += children[0]
        else:
            out.append(replace(s, children=children))
    if stats:
        i = 0
        while i < len(out):
            j = i
            while j < len(out) and out[j].kind == "has":
                j += 1
            out[i:j] = sorted(out[i:j], key=lambda s: stats.has(*s.args[:2]))
            i = max(j, i + 1)
    return tuple(out)


def compile_steps(spark: SparkSession, triples: DataFrame, steps: tuple[Step, ...]) -> DataFrame:
    """One column ``v`` of distinct vertices. ``Limit`` takes the first by id."""
    cur: DataFrame | None = None
    for s in steps:
        if s.kind == "vertex":
            cur = spark.range(1).select(F.lit(s.args[0]).alias("v"))
        elif s.kind == "morphism":
            raise TraversalError("a morphism is defined, not run")
        elif s.kind == "has":
            found = T.having(triples, *s.args)
            cur = found if cur is None else cur.join(found, "v", "left_semi")
        elif s.kind in ("and", "or", "not"):
            sets = [compile_steps(spark, triples, c) for c in s.children]
            if s.kind == "or":
                for other in sets:
                    cur = other if cur is None else cur.unionByName(other)
                cur = cur.distinct()
            elif s.kind == "and":
                for other in sets:
                    cur = other if cur is None else cur.join(other, "v", "left_semi")
            else:
                if cur is None:  # a difference of its children; of one child alone there is nothing
                    cur = sets.pop(0) if len(sets) > 1 else sets[0].limit(0)
                for other in sets:
                    cur = cur.join(other, "v", "left_anti")
        elif s.kind in ("out", "in"):
            if cur is None:
                raise TraversalError(f"{s.kind} needs vertices to start from")
            cur = (T.out_step if s.kind == "out" else T.in_step)(cur, triples, s.args[0])
        elif s.kind == "limit":
            cur = cur.orderBy("v").limit(s.args[0])
    return cur.select("v")


class Query:
    """Builds steps: ``Query().V("a").Out("p").Has("q", "x")``."""

    def __init__(self, steps: tuple[Step, ...] = ()):
        self.steps = steps

    def _with(self, kind: str, *args, children=()) -> Query:
        return Query((*self.steps, Step(kind, args, tuple(c.steps for c in children))))

    def V(self, vertex: str) -> Query:  # noqa: N802
        if self.steps:
            raise TraversalError("V must come first")
        return self._with("vertex", vertex)

    def Out(self, predicate: str) -> Query:  # noqa: N802
        return self._with("out", predicate)

    def In(self, predicate: str) -> Query:  # noqa: N802
        return self._with("in", predicate)

    def Has(self, predicate: str, value: str, op: str = "=") -> Query:  # noqa: N802
        return self._with("has", predicate, op, value)

    def HasGt(self, predicate: str, value: str) -> Query:  # noqa: N802
        return self.Has(predicate, value, ">")

    def HasGte(self, predicate: str, value: str) -> Query:  # noqa: N802
        return self.Has(predicate, value, ">=")

    def HasLt(self, predicate: str, value: str) -> Query:  # noqa: N802
        return self.Has(predicate, value, "<")

    def HasLte(self, predicate: str, value: str) -> Query:  # noqa: N802
        return self.Has(predicate, value, "<=")

    def And(self, *others: Query) -> Query:  # noqa: N802
        return self._with("and", children=others)

    def Or(self, *others: Query) -> Query:  # noqa: N802
        return self._with("or", children=others)

    def Not(self, *others: Query) -> Query:  # noqa: N802
        return self._with("not", children=others)

    Difference = Not

    def Limit(self, n: int) -> Query:  # noqa: N802
        return self._with("limit", n)

    def Follow(self, name: str) -> Query:  # noqa: N802
        return self._with("follow", name)


class IndexSchema:
    """``type T @index(spo, pos) { field: [U] @index(pos); }``: which indexes each predicate keeps."""

    _TYPE = re.compile(r"type\s+(\w+)\s*(?:@index\(([^)]*)\))?\s*\{([^}]*)\}")
    _FIELD = re.compile(r"(\w+)\s*:\s*(\[?\w+!?\]?!?)\s*(?:@index\(([^)]*)\))?\s*[;,\n]?")

    def __init__(self, source: str = ""):
        self.source = source
        self.indexes: dict[str, tuple[str, ...]] = {}
        self.types: dict[str, dict[str, str]] = {}
        text = re.sub(r"#[^\n]*", "", source)
        if rest := self._TYPE.sub("", text).strip():
            raise TraversalError(f"Expected a type at {text.index(rest[:1])}, got '{rest[:20]}'")
        for name, of_type, body in self._TYPE.findall(text):
            default = self._list(of_type) or ("spo", "pos")
            if rest := self._FIELD.sub("", body).strip():
                raise TraversalError(f"Expected a field of type '{name}', got '{rest[:20]}'")
            for field, kind, own in self._FIELD.findall(body):
                self.types.setdefault(name, {})[field] = kind
                self.indexes.setdefault(field, self._list(own) or default)

    @staticmethod
    def _list(text: str) -> tuple[str, ...]:
        found = tuple(x.strip() for x in text.split(",") if x.strip())
        for x in found:
            if x not in T.INDEXES:
                raise TraversalError(f"Unknown index '{x}'")
        return found

    def needs(self, predicate: str, index: str) -> bool:
        return index in self.indexes.get(predicate, T.INDEXES)


class Graph:
    """A triple table with named morphisms, an optional index schema and optional statistics."""

    def __init__(self, triples: DataFrame, schema: str = "", stats: Stats | None = None):
        self.spark, self.triples, self.schema, self.stats = triples.sparkSession, triples, IndexSchema(schema), stats
        self.morphisms: dict[str, tuple[Step, ...]] = {}
        self.subtree, self._pool = None, None

    def define_morphism(self, name: str, source: str) -> None:
        """``g.Morphism("name").Step(...)``; the first definition of a name stands."""
        steps = parse(source, self.morphisms)
        if steps[0] != Step("morphism", (name,)):
            raise TraversalError(f"the query does not define '{name}'")
        self.morphisms.setdefault(name, steps[1:])

    def _inline(self, steps: tuple[Step, ...]) -> tuple[Step, ...]:
        out: list[Step] = []
        for s in steps:
            if s.kind == "follow":
                if s.args[0] not in self.morphisms:
                    raise TraversalError(f"Unknown morphism '{s.args[0]}'")
                out += self.morphisms[s.args[0]]
            else:
                out.append(replace(s, children=tuple(map(self._inline, s.children))))
        return tuple(out)

    def plan(self, query: str | Query) -> tuple[Step, ...]:
        steps = parse(query, self.morphisms) if isinstance(query, str) else self._inline(query.steps)
        return optimise(steps, self.stats)

    def query(self, query: str | Query) -> DataFrame:
        return compile_steps(self.spark, self.triples, self.plan(query))

    def count(self, query: str | Query) -> DataFrame:
        return self.query(query).agg(F.count("*").alias("n"))

    def insert(self, rows: list[tuple[str, str, str]]) -> Graph:
        self.triples = T.insert(self.triples, self.spark.createDataFrame(rows, T.SCHEMA))
        return self

    def delete(self, rows: list[tuple[str, str, str]]) -> Graph:
        self.triples = T.delete(self.triples, self.spark.createDataFrame(rows, T.SCHEMA))
        return self

    def expand(self) -> DataFrame:
        return T.expand(self.triples, self.schema.indexes)

    def save(self, folder: str) -> None:
        """Triples by predicate, and beside them the schema and the statistics, so that a query need not make these."""
        T.write(self.triples, f"{folder}/triples")
        stored = self.spark.read.schema(T.SCHEMA).parquet(f"{folder}/triples")
        self.stats = Stats.of(stored)
        about = json.dumps({"schema": self.schema.source, "stats": self.stats.counts})
        self.spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/about")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Graph:
        rows = spark.read.schema(T.SCHEMA).parquet(f"{folder}/triples").select("s", "p", "o")
        about = json.loads(spark.read.parquet(f"{folder}/about").first().about)
        return cls(rows, about["schema"], Stats({p: tuple(n) for p, n in about["stats"].items()}))

    def analyse(self, query: str | Query | None = None) -> Graph:
        """Makes the statistics of all predicates, or of those that a query names: no other triples are read."""
        rows = self.triples
        if query is not None:
            steps = parse(query, self.morphisms) if isinstance(query, str) else self._inline(query.steps)
            rows = rows.where(F.col("p").isin(sorted(predicates_of(steps))))
        self.stats = Stats.of(rows)
        return self

    def estimates(self, query: str | Query) -> int:
        """The number of vertices that the statistics let expect."""
        return (self.stats or Stats({})).chain(self.plan(query))

    # As a layer of a store: one key for each index and triple, all of a call's keys in one transaction.

    @classmethod
    def open(cls, subtree, schema: str = "") -> Graph:
        """The graph that a subtree of a store holds; the subtree belongs to the graph layer from then on."""
        subtree.claim("graph")
        stored = subtree.get(["__meta", "schema"])
        if stored is None and schema:
            subtree.put(["__meta", "schema"], schema)
        out = cls(subtree.spark.createDataFrame([], T.SCHEMA), stored or schema)
        out.subtree = subtree
        out.triples = T.collapse(subtree.kv().select("path"))
        return out

    def _keys(self, rows: list[tuple[str, str, str]]) -> list[list[str]]:
        named = [dict(zip("spo", r)) for r in rows]
        return [[i, *(t[c] for c in i)] for t in named for i in T.INDEXES if self.schema.needs(t["p"], i)]

    def write(self, insert: list[tuple[str, str, str]] = (), delete: list[tuple[str, str, str]] = ()) -> Graph:
        """Inserts and deletes triples of a graph in a store: with all of their index keys or not at all."""
        ops = [{"type": "put", "key": k, "value": ""} for k in self._keys(insert)] + [{"type": "del", "key": k} for k in self._keys(delete)]
        self.subtree.batch(ops)
        self.triples = T.collapse(self.subtree.kv().select("path"))
        return self

    def submit(self, method: str, *args, **kwargs) -> Future:
        """Runs a method on a thread of the graph's own: ``submit("insert", rows)``, ``submit("query", text)``."""
        if self._pool is None:
            self._pool = ThreadPoolExecutor(1)
        return self._pool.submit(getattr(self, method), *args, **kwargs)
