"""GraphQL over paths ``{Plural}/{id}/{field}``: documents are parsed, and each root field is compiled to one lazy frame."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import split_text, starts_with
from ..operators import scans
from ..sources.store import ConflictError

#: How deep selections and fragments may go, and the names of the scalar types.
DEPTH, FRAGMENT_DEPTH = 15, 10
SCALARS = ("String", "Int", "Float", "Boolean", "ID")


class GraphQLError(ValueError):
    """``position``: the place in the document that the error is about, if it is known."""

    def __init__(self, message: str, position: int | None = None):
        super().__init__(message)
        self.position = position

    def entry(self, source: str, path: list[str]) -> dict[str, Any]:
        """The error as a result has it: message, path and, if known, line and column, both from 1."""
        if self.position is None:
            return {"message": str(self), "path": path}
        before = source[: self.position]
        return {"message": str(self), "path": path, "locations": [{"line": before.count("\n") + 1, "column": len(before) - before.rfind("\n")}]}


# Front end

_TOKENS = re.compile(r'[\s,﻿]+|#[^\n]*|(?P<spread>\.\.\.)|(?P<float>-?\d+(?:\.\d+(?:[eE][+-]?\d+)?|[eE][+-]?\d+))|(?P<int>-?\d+)|(?P<name>[A-Za-z_]\w*)|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<mark>[{}()\[\]:=!|@&])')


def lex(source: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(source):
        m = _TOKENS.match(source, at)
        if not m:
            raise GraphQLError(f"Unexpected character '{source[at]}' at {at}", at)
        if m.lastgroup:
            out.append((m.lastgroup, m.group(), at))
        at = m.end()
    return [*out, ("end", "", at)]


@dataclass
class Enum:
    name: str


@dataclass
class Selection:
    kind: str  # field, spread or inline
    name: str
    alias: str | None = None
    args: dict[str, Any] = field(default_factory=dict)
    directives: dict[str, dict[str, Any]] = field(default_factory=dict)
    children: list[Selection] = field(default_factory=list)
    repeated: list[tuple[str, Any]] = field(default_factory=list)
    position: int | None = None

    @property
    def output(self) -> str:
        return self.alias or self.name


@dataclass
class TypeRef:
    name: str
    listed: bool = False
    required: bool = False

    def __str__(self) -> str:
        return (f"[{self.name}]" if self.listed else self.name) + "!" * self.required


@dataclass
class Type:
    name: str
    kind: str
    plural: str
    fields: dict[str, TypeRef] = field(default_factory=dict)
    values: list[str] = field(default_factory=list)


@dataclass
class Document:
    operations: list[tuple[str, list[Selection]]] = field(default_factory=list)
    fragments: dict[str, Selection] = field(default_factory=dict)
    types: list[Type] = field(default_factory=list)
    roots: dict[str, str] = field(default_factory=dict)


class Parser:
    def __init__(self, source: str):
        self.tokens, self.at = lex(source), 0

    def peek(self, value: str | None = None) -> bool | str:
        return self.tokens[self.at][1] == value if value is not None else self.tokens[self.at][0]

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        k, v, position = self.tokens[self.at]
        if value not in (None, v) or kind not in (None, k):
            raise GraphQLError(f"Expected {value or kind} at {position}, got '{v}'", position)
        self.at += 1
        return v

    def skip(self, value: str) -> bool:
        if self.peek(value):
            self.at += 1
            return True
        return False

    def document(self) -> Document:
        doc = Document()
        while self.peek() != "end":
            if self.peek("{"):
                doc.operations.append(("query", self.selections()))
                continue
            word = self.take(kind="name")
            if word in ("query", "mutation"):
                if self.peek() == "name":
                    self.take()
                self.directives()
                doc.operations.append((word, self.selections()))
            elif word == "fragment":
                name = self.take(kind="name")
                self.take("on")
                on = self.take(kind="name")
                doc.fragments[name] = Selection("fragment", on, directives=self.directives(), children=self.selections())
            elif word in ("type", "enum", "scalar", "extend", "schema"):
                self.definition(doc, word)
            else:
                raise GraphQLError(f"Unexpected '{word}'", self.tokens[self.at - 1][2])
        return doc

    def definition(self, doc: Document, word: str) -> None:
        if word == "extend":
            word = self.take("type")
        if word == "schema":
            self.take("{")
            while not self.skip("}"):
                key = self.take(kind="name")
                self.take(":")
                doc.roots[key] = self.take(kind="name")
            return
        name = self.take(kind="name")
        marks = self.directives()
        out = Type(name, {"type": "OBJECT", "enum": "ENUM", "scalar": "SCALAR"}[word], name)
        if word == "type":
            out.plural = marks.get("plural", {}).get("name", name + "s")
            self.take("{")
            while not self.skip("}"):
                key = self.take(kind="name")
                if self.skip("("):
                    while not self.skip(")"):
                        self.at += 1
                self.take(":")
                out.fields.setdefault(key, self.type_ref())
                if self.skip("="):
                    self.value()
                self.directives()
        elif word == "enum":
            self.take("{")
            while not self.skip("}"):
                out.values.append(self.take(kind="name"))
        doc.types.append(out)

    def type_ref(self) -> TypeRef:
        if self.skip("["):
            name = self.take(kind="name")
            self.skip("!")
            self.take("]")
            return TypeRef(name, True, self.skip("!"))
        return TypeRef(self.take(kind="name"), False, self.skip("!"))

    def selections(self) -> list[Selection]:
        self.take("{")
        out = []
        while not self.skip("}"):
            position = self.tokens[self.at][2]
            if self.skip("..."):
                if self.skip("on"):
                    name = self.take(kind="name")
                    out.append(Selection("inline", name, directives=self.directives(), children=self.selections(), position=position))
                elif self.peek("{") or self.peek("@"):
                    out.append(Selection("inline", "", directives=self.directives(), children=self.selections()))
                else:
                    out.append(Selection("spread", self.take(kind="name"), directives=self.directives(), position=position))
                continue
            name, alias = self.take(kind="name"), None
            if self.skip(":"):
                alias, name = name, self.take(kind="name")
            repeated = self.arguments()
            marks = self.directives()
            out.append(Selection("field", name, alias, dict(repeated), marks, self.selections() if self.peek("{") else [], repeated, position))
        return out

    def arguments(self) -> list[tuple[str, Any]]:
        out = []
        if self.skip("("):
            while not self.skip(")"):
                name = self.take(kind="name")
                self.take(":")
                out.append((name, self.value()))
        return out

    def directives(self) -> dict[str, dict[str, Any]]:
        out = {}
        while self.skip("@"):
            name = self.take(kind="name")
            out[name] = dict(self.arguments())
        return out

    def value(self) -> Any:
        kind, text, position = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return json.loads(text)
        if kind == "int":
            return int(text)
        if kind == "float":
            return float(text)
        if kind == "name":
            return {"true": True, "false": False, "null": None}.get(text, Enum(text))
        if text == "[":
            out = []
            while not self.skip("]"):
                out.append(self.value())
            return out
        if text == "{":
            found = {}
            while not self.skip("}"):
                key = self.take(kind="name")
                self.take(":")
                found[key] = self.value()
            return found
        raise GraphQLError(f"Expected a value at {position}", position)


def parse(source: str) -> Document:
    return Parser(source).document()


def text_of(value: Any) -> str | None:
    """How a literal is stored: text; strings inside lists and objects are not quoted."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Enum):
        return value.name
    if isinstance(value, list):
        return "[" + ", ".join(text_of(v) or "null" for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {text_of(v) or 'null'}" for k, v in value.items()) + "}"
    return str(value)


# Planning and resolution

Resolver = Callable[[Column, dict[str, Any]], Column]


class GraphQL:
    """A schema over a ``kv`` frame (``path``, ``value``) or a store. Queries read one snapshot; mutations need a store.

    ``store`` is a store or a subtree of one.
    """

    def __init__(self, sdl: str, kv: DataFrame | None = None, store=None):
        self.types: dict[str, Type] = {}
        self.roots: dict[str, str] = {}
        self.resolvers: dict[tuple[str, str], Resolver] = {}
        self._kv, self.store, self._pool = kv, store, None
        self.define(sdl)

    def define(self, sdl: str) -> None:
        """Adds types; fields of a type defined again are merged, the first definition of a field stands."""
        doc = parse(sdl)
        for t in doc.types:
            known = self.types.setdefault(t.name, t)
            for name, ref in t.fields.items():
                known.fields.setdefault(name, ref)
        self.roots |= doc.roots

    def save(self) -> None:
        """Keeps the schema in the store: one definition a type."""
        self.store.put_many({("__schema", "types", t.name): self.sdl_of(t) for t in self.types.values()})
        if self.roots:
            self.store.put(["__schema", "roots"], "schema { " + " ".join(f"{k}: {v}" for k, v in self.roots.items()) + " }")

    @classmethod
    def load(cls, store) -> GraphQL:
        rows = store.kv().where(starts_with("path", ["__schema"])).orderBy("path").collect()
        return cls("\n".join(r.value for r in rows), store=store)

    @staticmethod
    def sdl_of(t: Type) -> str:
        if t.kind == "SCALAR":
            return f"scalar {t.name}"
        if t.kind == "ENUM":
            return f"enum {t.name} {{ {' '.join(t.values)} }}"
        fields = " ".join(f"{n}: {r}" for n, r in t.fields.items())
        return f'type {t.name} @plural(name: "{t.plural}") {{ {fields} }}'

    def register(self, type_name: str, field_name: str, resolver: Resolver) -> None:
        """``resolver(id column, arguments)`` gives the field's column in place of the stored value."""
        self.resolvers[type_name, field_name] = resolver

    @property
    def kv(self) -> DataFrame:
        return self._kv if self._kv is not None else self.store.kv()

    def root(self, name: str) -> Type | None:
        """The type whose name or plural a root field has; else that of a field of the declared query type."""
        for t in self.types.values():
            if t.kind == "OBJECT" and name in (t.name, t.plural):
                return t
        declared = self.types.get(self.roots.get("query", "Query"))
        ref = declared.fields.get(name) if declared else None
        return self.types.get(ref.name) if ref else None

    def expand(self, selections: list[Selection], fragments: dict[str, Selection], seen: tuple[str, ...] = ()) -> list[Selection]:
        """Selections without directives and fragments; a fragment inside itself is left out."""
        out: list[Selection] = []
        for s in selections:
            if s.directives.get("skip", {}).get("if") is True or s.directives.get("include", {}).get("if") is False:
                continue
            if s.kind == "field":
                out.append(s)
            elif s.kind == "inline":
                out += self.expand(s.children, fragments, seen)
            elif s.name not in fragments:
                raise GraphQLError(f"Unknown fragment '{s.name}'", s.position)
            elif s.name not in seen and len(seen) < FRAGMENT_DEPTH:
                out += self.expand(fragments[s.name].children, fragments, (*seen, s.name))
        names: dict[str, Selection] = {}
        for s in out:  # the same output twice is one field with both selections; a fragment's own selections stay as they are
            first = names.setdefault(s.output, s)
            if first is not s and s.children:
                names[s.output] = replace(first, children=first.children + s.children)
        return list(names.values())

    @staticmethod
    def cast(value: Column, name: str) -> Column:
        if name == "Int":
            return value.try_cast("bigint")
        if name == "Float":
            return value.try_cast("double")
        return value == "true" if name == "Boolean" else value

    def _cast_item(self, name: str, item: Column) -> Column:
        return self.cast(item, name)

    def objects(self, t: Type, selections: list[Selection], fragments: dict[str, Selection], ids: DataFrame | None = None, depth: int = 0, among: DataFrame | None = None) -> DataFrame:
        """``id`` and ``object`` (a struct) of the entities of a type, or of those in ``ids`` whether they exist or not.

        All stored fields come from one aggregation over the type's paths; references are joins. With ``ids``, or ``among`` (a
        column ``id``), only the paths of these entities are aggregated, and of the entities they refer to only those.
        """
        if depth > DEPTH:
            raise GraphQLError("Maximum depth exceeded")
        selections = self.expand(selections, fragments)
        part = lambda i: F.get(F.col("path"), F.lit(i))
        rows = scans.below(self.kv, [t.plural]).select("path", "value").where(starts_with("path", [t.plural]) & (F.size("path") >= 2) & ~part(1).startswith("__"))
        among = ids if ids is not None else among
        if among is not None:
            rows = rows.withColumn("__id", part(1)).join(among.select(F.col("id").alias("__id")).distinct(), "__id", "left_semi").drop("__id")
        stored, lists, nested = [], [], []
        for s in selections:
            if s.name in ("id", "__typename") or (t.name, s.name) in self.resolvers:
                continue
            ref = t.fields.get(s.name)
            if ref is None:
                raise GraphQLError(f"Unknown field '{s.name}' on type '{t.name}'", s.position)
            target = self.types.get(ref.name)
            if target is not None and target.kind == "OBJECT":
                if not s.children:
                    raise GraphQLError(f"Field '{s.name}' needs a selection", s.position)
                (lists if ref.listed else nested).append((s, target))
            elif s.children:
                raise GraphQLError(f"Field '{s.name}' has no fields", s.position)
            stored.append((s.name, ref.listed))
        values = []
        for name in dict.fromkeys(n for n, listed in stored if not listed):
            values.append(F.max(F.when((F.size("path") == 3) & (part(2) == name), F.col("value"))).alias(f"f_{name}"))
        for name in dict.fromkeys(n for n, listed in stored if listed and n not in {s.name for s, _ in lists}):
            inside = F.when((F.size("path") == 4) & (part(2) == name), F.struct(part(3).alias("k"), F.col("value").alias("v")))
            values.append(F.transform(F.array_sort(F.collect_list(inside)), lambda x: x["v"]).alias(f"f_{name}"))
        wide = rows.groupBy(part(1).alias("id")).agg(F.count("*").alias("__n"), *values)
        if ids is not None:
            wide = ids.join(wide, "id", "left")
        for s, target in nested:
            named = None if among is None else wide.select(F.col(f"f_{s.name}").alias("id")).where(F.col("id").isNotNull())
            got = self.objects(target, s.children, fragments, depth=depth + 1, among=named).select(F.col("id").alias(f"f_{s.name}"), F.col("object").alias(f"o_{s.output}"))
            wide = wide.join(got, f"f_{s.name}", "left")
        for s, target in lists:
            links = rows.where((F.size("path") == 4) & (part(2) == s.name)).select(part(1).alias("id"), part(3).alias("k"), F.col("value").alias("target"))
            named = None if among is None else links.select(F.col("target").alias("id"))
            got = self.objects(target, s.children, fragments, depth=depth + 1, among=named).select(F.col("id").alias("target"), "object")
            listed = links.join(got, "target").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "target", "object"))).alias("l"))
            wide = wide.join(listed.select("id", F.transform("l", lambda x: x["object"]).alias(f"o_{s.output}")), "id", "left")
        columns = [] if any(s.output == "id" for s in selections) else [F.col("id").alias("id")]
        for s in selections:
            if s.name == "id":
                value = F.col("id")
            elif s.name == "__typename":
                value = F.lit(t.name)
            elif (t.name, s.name) in self.resolvers:
                value = self.resolvers[t.name, s.name](F.col("id"), s.args)
            elif any(s is x for x, _ in nested + lists):
                value = F.col(f"o_{s.output}")
                if any(s is x for x, _ in lists):
                    value = F.coalesce(value, F.array())
            else:
                ref = t.fields[s.name]
                value = F.transform(f"f_{s.name}", partial(self._cast_item, ref.name)) if ref.listed else self.cast(F.col(f"f_{s.name}"), ref.name)
            columns.append(value.alias(s.output))
        order = ["pos"] if ids is not None and "pos" in ids.columns else []
        return wide.select(*order, "id", F.struct(*columns).alias("object"))

    def frame(self, query: str, field_index: int = 0) -> DataFrame:
        """One root field of a query as rows: a column for each selected field."""
        doc = parse(query)
        if not doc.operations:
            raise GraphQLError("No operation")
        roots = self.expand(doc.operations[0][1], doc.fragments)
        out = self._root(roots[field_index], doc.fragments)
        return out.select(*(["pos"] if "pos" in out.columns else []), "object.*")

    def stored_at(self, name: str) -> DataFrame:
        """``value`` of one path, given with slashes: what a root field without a type reads."""
        return scans.get(self.kv, split_text(name)).select("value")

    def _root(self, s: Selection, fragments: dict[str, Selection]) -> DataFrame:
        t = self.root(s.name)
        if t is None:
            raise GraphQLError(f"Unknown field '{s.name}'", s.position)
        if not s.children:
            raise GraphQLError(f"Field '{s.name}' needs a selection", s.position)
        asked = [text_of(v) for k, v in s.repeated if k == "id"]
        if asked and isinstance(s.args["id"], list):
            asked = [text_of(v) for v in s.args["id"]]
        ids = self.kv.sparkSession.createDataFrame(list(enumerate(asked)), "pos int, id string") if asked else None
        return self.objects(t, s.children, fragments, ids)

    def explain(self, query: str) -> list[str]:
        """What each root field becomes: a scan of a type, or a fetch of ids."""
        doc = parse(query)
        return [f"{self._kind(s)} {s.name}" for s in self.expand(doc.operations[0][1], doc.fragments)]

    def _kind(self, s: Selection) -> str:
        if self.root(s.name) is None and not s.children and not s.name.startswith("__"):
            return "GET"
        return "BATCH_GET" if "id" in s.args else "SCAN"

    def plan_text(self, query: str) -> str:
        """The whole plan, a line a step, nested ones indented."""
        doc = parse(query)
        lines: list[str] = []

        def walk(t: Type | None, selections: list[Selection], depth: int) -> None:
            for s in self.expand(selections, doc.fragments):
                ref = t.fields.get(s.name) if t else None
                target = self.types.get(ref.name) if ref else None
                custom = t is not None and (t.name, s.name) in self.resolvers
                kind = "CUSTOM" if custom else "RESOLVE_REF" if target is not None and target.kind == "OBJECT" else "RESOLVE_FIELD"
                lines.append("  " * depth + f"{kind} {s.name}" + f" -> {ref}" * bool(ref) + f" as {s.alias}" * bool(s.alias))
                if depth < DEPTH:
                    walk(target, s.children, depth + 1)

        for s in self.expand(doc.operations[0][1], doc.fragments):
            lines.append(f"{self._kind(s)} {s.name}" + "".join(f" {k}={text_of(v)}" for k, v in s.repeated))
            walk(self.root(s.name), s.children, 1)
        return "\n".join(lines)

    def submit(self, method: str, *args) -> Future:
        """Runs a method on a thread of the layer's own: ``submit("execute", query)``."""
        if self._pool is None:
            self._pool = ThreadPoolExecutor(1)
        return self._pool.submit(getattr(self, method), *args)

    def execute(self, query: str) -> dict[str, Any]:
        """``{"data": ..., "errors": [...]}``: fields that fail are null and the others stand. One result is one driver value."""
        try:
            doc = parse(query)
            if not doc.operations:
                raise GraphQLError("No operation")
            kind, selections = doc.operations[0]
            roots = self.expand(selections, doc.fragments)
        except GraphQLError as e:
            return {"data": None, "errors": [e.entry(query, [])]}
        data: dict[str, Any] = {}
        errors: list[dict] = []
        for s in roots:
            try:
                if kind == "mutation":
                    name, value = self._mutate(s, doc.fragments)
                    data[s.alias or name] = value
                elif s.name == "__schema":
                    data[s.output] = {"types": self.introspect()}
                elif s.name == "__type":
                    data[s.output] = next((t for t in self.introspect() if t["name"] == s.args.get("name")), None)
                elif self.root(s.name) is None and not s.children:
                    path = text_of(s.args["path"]) if "path" in s.args else s.name
                    row = self.stored_at(path).first()
                    if row is None:
                        raise GraphQLError(f"Unknown field '{s.name}'", s.position)
                    data[s.output] = row.value
                else:
                    rows = self._root(s, doc.fragments)
                    order = "pos" if "pos" in rows.columns else "id"
                    found = [json.loads(r.j) for r in rows.orderBy(order).select(F.to_json("object", {"ignoreNullFields": "false"}).alias("j")).collect()]
                    data[s.output] = found[0] if "id" in s.args and len(found) == 1 else found
            except GraphQLError as e:
                data[s.output] = None
                errors.append(e.entry(query, [s.output]))
        return {"data": data, **({"errors": errors} if errors else {})}

    def to_json(self, query: str) -> str:
        return json.dumps(self.execute(query), ensure_ascii=False)

    def introspect(self) -> list[dict[str, Any]]:
        return [{"name": t.name, "kind": t.kind, "__typename": "__Type", "fields": [{"name": n, "type": str(r)} for n, r in t.fields.items()], "enumValues": t.values} for t in self.types.values()]

    def introspect_frame(self, spark) -> DataFrame:
        rows = [(t.name, t.kind, n, str(r)) for t in self.types.values() for n, r in (t.fields.items() or [(v, "") for v in t.values] or [(None, "")])]
        return spark.createDataFrame(rows, "type_name string, kind string, field string, field_type string")

    def _written(self, t: Type, key: str | None, given: dict[str, Any], new: bool) -> str:
        """Writes an entity's fields, and the counter that its key is taken from, in one transaction; returns the key."""
        with self.store.transaction() as txn:
            if key is None:
                counter = [t.plural, "__meta", "next_id"]
                key = str(int(txn.get(counter) or 0) + 1)
                txn.put(counter, key)
            for name, value in given.items():
                if t.fields[name].listed and isinstance(value, list):
                    for i, v in enumerate(value):
                        txn.put([t.plural, key, name, f"{i:06d}"], text_of(v) or "")
                elif value is not None:
                    txn.put([t.plural, key, name], text_of(value))
            if new and "id" in t.fields:
                txn.put([t.plural, key, "id"], key)
        return key

    def _mutate(self, s: Selection, fragments: dict[str, Selection]) -> tuple[str, Any]:
        m = re.fullmatch(r"(create|update|delete)(\w+)", s.name)
        t = self.types.get(m[2][0].upper() + m[2][1:]) if m else None
        if t is None or self.store is None:
            raise GraphQLError(f"Unknown mutation '{s.name}'", s.position)
        given = {k: v for k, v in s.args.items() if k != "id"}
        unknown = [k for k in given if k not in t.fields]
        if unknown:
            raise GraphQLError(f"Unknown field '{unknown[0]}' on type '{t.name}'", s.position)
        if m[1] == "create":
            missing = [n for n, r in t.fields.items() if r.required and n not in given and r.name != "ID"]
            if missing:
                raise GraphQLError("Missing required fields: " + ", ".join(missing), s.position)
        elif "id" not in s.args:
            raise GraphQLError("Missing id", s.position)
        if m[1] == "delete":
            key = text_of(s.args["id"])
            self.store.delete_prefix([t.plural, key])
            return t.name, {"id": key}
        key = None
        while key is None:
            try:
                key = self._written(t, text_of(s.args["id"]) if "id" in s.args else None, given, m[1] == "create")
            except ConflictError:  # another writer has taken the number
                continue
        ids = self.store.spark.createDataFrame([(0, key)], "pos int, id string")
        row = self.objects(t, s.children or [Selection("field", "id")], fragments, ids).select(F.to_json("object", {"ignoreNullFields": "false"}).alias("j")).first()
        return t.name, json.loads(row.j)
