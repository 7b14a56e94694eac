"""SQL on collections: SELECT, INSERT, UPDATE, DELETE, CREATE TABLE, DROP TABLE.

A small parser reads the six statements and hands expressions to Spark's parser, so
WHERE takes all that Spark SQL has. A query that isn't of the small form goes to
Spark as a whole, with collections in place of their names. ``strict`` accepts only
conjunctions of comparisons between a field and a literal, and no larger queries.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import ParseException

from docspark.errors import CollectionNotFound, InvalidArgument, SpaceExists
from docspark.functions import values as V

_token = re.compile(r"\s*(?:('(?:[^']|'')*')|([A-Za-z_][\w.]*)|([-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)|(<=|>=|<>|!=|[=<>(),*;]))")
KEYWORDS = {"SELECT", "FROM", "WHERE", "ORDER", "BY", "LIMIT", "OFFSET", "AND", "ASC", "DESC", "INSERT", "INTO", "VALUES", "UPDATE", "SET", "DELETE", "CREATE", "DROP", "TABLE", "NOT", "NULL"}


@dataclass
class Token:
    kind: str  # word, number, string, symbol
    text: str
    start: int
    end: int


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while text[at:].strip():
        m = _token.match(text, at)
        if not m:
            raise InvalidArgument(f"can't read {text[at : at + 20]!r}")
        kind = ("string", "word", "number", "symbol")[m.lastindex - 1]
        out.append(Token(kind, m[m.lastindex], m.start(m.lastindex), m.end()))
        at = m.end()
    return out[:-1] if out and out[-1].text == ";" else out


def literal(t: Token):
    if t.kind == "string":
        return t.text[1:-1].replace("''", "'")
    if t.kind == "number":
        return int(t.text) if re.fullmatch(r"[-+]?\d+", t.text) else float(t.text)
    if t.kind == "word" and t.text.upper() in ("TRUE", "FALSE"):
        return t.text.upper() == "TRUE"
    if t.kind == "word" and t.text.upper() == "NULL":
        return None
    raise InvalidArgument(f"{t.text!r} isn't a literal")


@dataclass
class Select:
    table: str
    columns: list[str] | None
    where: str | None = None
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class Reader:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens(text), 0

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at].kind in ("word", "symbol") and self.tokens[self.at].text.upper() in words

    def take(self, *words: str) -> bool:
        found = self.peek(*words)
        self.at += found
        return found

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                raise InvalidArgument(f"{w} expected at {self.rest()!r}")

    def rest(self) -> str:
        return self.text[self.tokens[self.at].start :][:20] if self.at < len(self.tokens) else ""

    def next(self) -> Token:
        if self.at >= len(self.tokens):
            raise InvalidArgument("the statement ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> str:
        t = self.next()
        if t.kind != "word" or t.text.upper() in KEYWORDS:
            raise InvalidArgument(f"a name expected, not {t.text!r}")
        return t.text

    def integer(self) -> int:
        v = literal(self.next())
        if not isinstance(v, int) or v < 0:
            raise InvalidArgument("a count expected")
        return v

    def where(self) -> str | None:
        """The text of the condition, up to ORDER, LIMIT, OFFSET or the end."""
        if not self.take("WHERE"):
            return None
        first, depth = self.at, 0
        while self.at < len(self.tokens) and not (depth == 0 and self.peek("ORDER", "LIMIT", "OFFSET", "GROUP", "HAVING", "UNION")):
            depth += self.tokens[self.at].text == "("
            depth -= self.tokens[self.at].text == ")"
            self.at += 1
        if first == self.at:
            raise InvalidArgument("WHERE without a condition")
        return self.text[self.tokens[first].start : self.tokens[self.at - 1].end]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise InvalidArgument(f"unexpected {self.rest()!r}")


def parse_select(text: str) -> Select:
    r = Reader(text)
    r.need("SELECT")
    columns = None
    if not r.take("*"):
        columns = [r.name()]
        while r.take(","):
            columns.append(r.name())
    r.need("FROM")
    out = Select(r.name(), columns, r.where())
    if r.take("ORDER"):
        r.need("BY")
        while True:
            name = r.name()
            down = r.take("DESC")
            if not down:
                r.take("ASC")
            out.order.append((name, down))
            if not r.take(","):
                break
    if r.take("LIMIT"):
        out.limit = r.integer()
    if r.take("OFFSET"):
        out.offset = r.integer()
    r.end()
    return out


def condition_of(where: str) -> dict:
    """The condition document of a conjunction of comparisons."""
    names = {"=": "$eq", "<>": "$ne", "!=": "$ne", "<": "$lt", "<=": "$lte", ">": "$gt", ">=": "$gte"}
    r, parts = Reader(where), []
    while True:
        name, op = r.name(), r.next().text
        if op not in names:
            raise InvalidArgument(f"unknown comparison {op!r}")
        parts.append({name: {names[op]: literal(r.next())}})
        if not r.take("AND"):
            break
    r.end()
    return {"$and": parts}


def select(df: DataFrame, q: Select, strict: bool = False) -> DataFrame:
    """Filter, sort, skip, limit and project; LIMIT 0 gives no rows."""
    from docspark.functions.predicates import compile_condition

    if q.where:
        df = df.where(compile_condition(condition_of(q.where), df.schema) if strict else F.expr(q.where))
    if q.order:
        keys = [V.top(n).desc_nulls_last() if down else V.top(n).asc_nulls_first() for n, down in q.order if n in df.columns]
        df = df.orderBy(*keys) if keys else df
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return df if q.columns is None else df.select(*[V.top(c) for c in q.columns if c in df.columns])


TYPES = {"INT": "int", "INTEGER": "int", "BIGINT": "bigint", "LONG": "bigint", "DOUBLE": "double", "FLOAT": "double", "STRING": "string", "TEXT": "string", "VARCHAR": "string", "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def parse_create(text: str) -> tuple[str, T.StructType]:
    r = Reader(text)
    r.need("CREATE", "TABLE")
    name, fields = r.name(), []
    r.need("(")
    while True:
        column, kind = r.name(), r.name().upper()
        if kind not in TYPES:
            raise InvalidArgument(f"unknown type {kind}")
        if r.take("("):
            r.integer()
            r.need(")")
        not_null = r.take("NOT")
        if not_null:
            r.need("NULL")
        fields.append(f"{column} {TYPES[kind]}")
        if not r.take(","):
            break
    r.need(")")
    r.end()
    return name, T.StructType.fromDDL(", ".join(fields))


def parse_insert(text: str) -> tuple[str, list[str] | None, list[list]]:
    r = Reader(text)
    r.need("INSERT", "INTO")
    table, names, rows = r.name(), None, []
    if r.take("("):
        names = [r.name()]
        while r.take(","):
            names.append(r.name())
        r.need(")")
    r.need("VALUES")
    while True:
        r.need("(")
        row = [literal(r.next())]
        while r.take(","):
            row.append(literal(r.next()))
        r.need(")")
        rows.append(row)
        if not r.take(","):
            break
    r.end()
    return table, names, rows


def parse_update(text: str) -> tuple[str, dict, str | None]:
    r = Reader(text)
    r.need("UPDATE")
    table, values = r.name(), {}
    r.need("SET")
    while True:
        name = r.name()
        r.need("=")
        values[name] = literal(r.next())
        if not r.take(","):
            break
    where = r.where()
    r.end()
    return table, values, where


def parse_delete(text: str) -> tuple[str, str | None]:
    r = Reader(text)
    r.need("DELETE", "FROM")
    table, where = r.name(), r.where()
    r.end()
    return table, where


def _with_views(db, text: str) -> DataFrame:
    """Spark's own SQL, with the collections that the text names as views."""
    for full in sorted(db.collections(), key=len, reverse=True):
        name = re.compile(rf"(?<![\w.`]){re.escape(full)}(?!\w)(?=(?:[^']*'[^']*')*[^']*$)")
        if name.search(text):
            view = "c_" + re.sub(r"\W", "_", full)
            db[full].df().createOrReplaceTempView(view)
            text = name.sub(view, text)
    return db.spark.sql(text)


def execute(db, text: str, strict: bool = False) -> DataFrame | None:
    """The rows of a query; None for other statements."""
    kind = (re.match(r"\s*(\w+)", text) or [""])[0].strip().upper()
    try:
        if kind in ("SELECT", "WITH"):
            try:
                q = parse_select(text)
            except InvalidArgument:
                if strict:
                    raise
                return _with_views(db, text)
            db.counters.add("queries")
            return select(db[q.table].df(), q, strict)
        if kind == "INSERT":
            table, names, rows = parse_insert(text)
            target = db[table]
            names = names or target._schema().fieldNames()
            if not names or any(len(r) > len(names) for r in rows):
                raise InvalidArgument("more values than columns")
            target.insert([dict(zip(names, r)) for r in rows])
        elif kind == "UPDATE":
            table, values, where = parse_update(text)
            db[table].update(condition_of(where) if where else {}, {"$set": values})
        elif kind == "DELETE":
            table, where = parse_delete(text)
            db[table].delete(condition_of(where) if where else {})
        elif kind == "CREATE":
            name, schema = parse_create(text)
            try:
                db.create_collection_space(name.partition(".")[0])
            except SpaceExists:
                pass
            db.create_collection(name, schema)
        elif kind == "DROP":
            r = Reader(text)
            r.need("DROP", "TABLE")
            name = r.name()
            r.end()
            db.drop_collection(name)
        else:
            raise InvalidArgument(f"unknown statement {kind}")
    except ParseException as e:
        raise InvalidArgument(str(e)) from e
    return None


__all__ = ["CollectionNotFound", "condition_of", "execute", "parse_create", "parse_delete", "parse_insert", "parse_select", "parse_update", "select"]
