"""Graphs of typed expressions over exact rationals, as columns.

A graph maps names to nodes, tuples of an operation and its operands (names of nodes, but for the first two):

  literal value            a scalar (num, den), a vector ((num, den), (num, den)), or a boolean
  column name              a column STRUCT<num, den> of the rows, such as a time or a keyed value
  link a, vector a b, component a "x" | "y"
  add, subtract            two scalars or two vectors
  multiply, divide         a scalar or a vector, by a scalar
  modulo, minimum, maximum, floor, less     scalars; modulo has the sign of its positive divisor
  equal                    two values of one kind
  and, not, select c a b   booleans; select takes a or b
  seeded stream a          a fraction of 2 ** 32, from a hash of seed, stream and the whole number a

Every node is evaluated, so an error in an arm that select does not take still counts. An error makes all values of
its row null; null in a column passes through what uses it, without an error. Each node is one column: what several nodes use is computed
once, and a chain's plan grows with the number of nodes alone.
"""

from __future__ import annotations

from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicework.functions.rational import BOUND, gcd

MOST_NODES, MOST_DEPTH, MOST_DEN = 256, 64, 10**12
#: Which kinds the operands of an operation have; N is a scalar or a vector, alike in one node; the last is the result.
KINDS = {
    "add": "NNN", "subtract": "NNN", "multiply": "NSN", "divide": "NSN", "modulo": "SSS", "minimum": "SSS", "maximum": "SSS", "floor": "SS",
    "less": "SSB", "equal": "AAB", "and": "BBB", "not": "BB", "select": "BAAA", "link": "AA", "vector": "SSV", "component": "VS",
}


def _operands(node: tuple) -> list[str]:
    op, *args = node
    return {"literal": [], "column": [], "component": args[:1], "seeded": args[1:]}.get(op, args)


def _literal_kind(value: object) -> str:
    if isinstance(value, bool):
        return "B"
    return "V" if isinstance(value[0], tuple) else "S"


def ordered_kinds(nodes: dict[str, tuple]) -> dict[str, str]:
    """Each node's kind (S, V or B), in an order in which operands come first; raises ValueError on what is not a graph."""
    if not 0 < len(nodes) <= MOST_NODES:
        raise ValueError(f"a graph has 1 to {MOST_NODES} nodes")
    for name, node in nodes.items():
        if missing := [a for a in _operands(node) if a not in nodes]:
            raise ValueError(f"{name} names no node: {missing[0]}")
    kinds, depth = {}, {}
    for name in TopologicalSorter({n: _operands(x) for n, x in nodes.items()}).static_order():  # CycleError is a ValueError
        op, *args = nodes[name]
        have = [kinds[a] for a in _operands(nodes[name])]
        depth[name] = 1 + max((depth[a] for a in _operands(nodes[name])), default=0)
        if depth[name] > MOST_DEPTH:
            raise ValueError(f"{name} lies deeper than {MOST_DEPTH}")
        if op in ("literal", "column", "seeded"):
            kinds[name] = _literal_kind(args[0]) if op == "literal" else "S"
            if op == "seeded" and have != ["S"]:
                raise ValueError(f"{name}: operands do not fit seeded")
            continue
        *wanted, result = KINDS[op]
        free = {h for w, h in zip(wanted, have, strict=True) if w in "NA"}
        fits = all(w == h for w, h in zip(wanted, have, strict=True) if w in "SVB") and len(free) <= 1 and not ("N" in wanted and free == {"B"})
        if not fits:
            raise ValueError(f"{name}: operands do not fit {op}")
        kinds[name] = free.pop() if result in "NA" else result
    return kinds


def _wide(c: Column) -> Column:
    return c.cast("decimal(18,0)")


def _made(num: Column, den: Column) -> Column:
    """In lowest terms; null where it does not fit."""
    pair = F.struct(num.cast("decimal(38,0)").alias("n"), den.cast("decimal(38,0)").alias("d"), gcd(F.abs(num), den).alias("g"))
    low = lambda p, c: F.try_divide(p[c], p["g"]).cast("decimal(32,0)")
    whole = F.transform(F.array(pair), lambda p: F.struct(low(p, "n").alias("num"), low(p, "d").alias("den")))
    small = F.filter(whole, lambda p: F.coalesce((F.abs(p["num"]) <= BOUND) & (p["den"] <= MOST_DEN), F.lit(False)))
    return F.get(F.transform(small, lambda p: F.struct(p["num"].cast("long").alias("num"), p["den"].cast("long").alias("den"))), 0)


def _sum(a: Column, b: Column, sign: int = 1) -> Column:
    return _made(_wide(a["num"]) * _wide(b["den"]) + _wide(b["num"]) * _wide(a["den"]) * sign, _wide(a["den"]) * _wide(b["den"]))


def _product(a: Column, b: Column) -> Column:
    return _made(_wide(a["num"]) * _wide(b["num"]), _wide(a["den"]) * _wide(b["den"]))


def _quotient(a: Column, b: Column) -> Column:
    sign = F.when(b["num"] < 0, -1).otherwise(1)
    return F.when(b["num"] != 0, _made(_wide(a["num"]) * _wide(b["den"]) * sign, _wide(a["den"]) * _wide(F.abs(b["num"]))))


def _whole(num: Column, den: Column) -> Column:
    """The floor of num / den, exactly."""
    n, d = num.cast("decimal(38,0)"), den.cast("decimal(38,0)")
    return F.try_divide(n - F.pmod(n, d), d).cast("decimal(32,0)")


def _modulo(a: Column, b: Column) -> Column:
    times = _whole(_wide(a["num"]) * _wide(b["den"]), _wide(a["den"]) * _wide(b["num"])).cast("decimal(18,0)")
    num = _wide(a["num"]) * _wide(b["den"]) - (times * _wide(b["num"])).cast("decimal(36,0)") * a["den"].cast("decimal(14,0)")
    return F.when(b["num"] > 0, _made(num, _wide(a["den"]) * _wide(b["den"])))


def _less(a: Column, b: Column) -> Column:
    return _wide(a["num"]) * _wide(b["den"]) < _wide(b["num"]) * _wide(a["den"])


def _little_endian(n: Column, size: int) -> Column:
    digits = F.lpad(F.hex(n), size * 2, "0")
    return F.unhex(F.concat(*(F.substring(digits, size * 2 - 1 - 2 * i, 2) for i in range(size))))


def seeded(tag: bytes, seed: int, stream: int, index: Column) -> Column:
    """A fraction of 2 ** 32: the first four bytes of the SHA-256 of tag, seed, stream and index, all little-endian."""
    start = F.unhex(F.lit((tag + seed.to_bytes(8, "little") + stream.to_bytes(4, "little")).hex()))
    head = F.substring(F.sha2(F.concat(start, _little_endian(index, 4)), 256), 1, 8)
    number = F.conv(F.concat(*(F.substring(head, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")
    return _made(number, F.lit(2**32))


def _column(op: str, args: list, x: list[Column], kinds: list[str], tag: bytes, seed: int) -> tuple[Column, Column | None]:
    """A node's value, and what is wrong with it where that is known from its operands (null: nothing, or what fits)."""
    pair = lambda f: F.struct(*(f(x[0][c], x[1] if kinds[1] == "S" else x[1][c]).alias(c) for c in "xy")) if kinds[0] == "V" else f(x[0], x[1])
    scalar = lambda v: F.struct(F.lit(v[0]).cast("long").alias("num"), F.lit(v[1]).cast("long").alias("den"))
    domain = lambda c: F.when(c, "domain")
    match op:
        case "literal" if isinstance(args[0], bool):
            return F.lit(args[0]), None
        case "literal" if isinstance(args[0][0], tuple):
            return F.struct(*(_made(scalar(v)["num"], scalar(v)["den"]).alias(c) for c, v in zip("xy", args[0], strict=True))), None
        case "literal":
            return _made(scalar(args[0])["num"], scalar(args[0])["den"]), None
        case "column":
            return _made(F.col(args[0])["num"], F.col(args[0])["den"]), None
        case "link":
            return x[0], None
        case "vector":
            return F.struct(x[0].alias("x"), x[1].alias("y")), None
        case "component":
            return x[0][args[1]], None
        case "add":
            return pair(_sum), None
        case "subtract":
            return pair(lambda a, b: _sum(a, b, -1)), None
        case "multiply":
            return pair(_product), None
        case "divide":
            return pair(_quotient), domain(x[1]["num"] == 0)
        case "modulo":
            return _modulo(*x), domain(x[1]["num"] <= 0)
        case "minimum":
            return F.when(_less(*x), x[0]).otherwise(x[1]), None
        case "maximum":
            return F.when(_less(*x), x[1]).otherwise(x[0]), None
        case "floor":
            return F.struct(_whole(x[0]["num"], x[0]["den"]).cast("long").alias("num"), F.lit(1).cast("long").alias("den")), None
        case "less":
            return _less(*x), None
        case "equal":
            return x[0] == x[1], None
        case "and":
            return x[0] & x[1], None
        case "not":
            return ~x[0], None
        case "select":
            return F.when(x[0], x[1]).otherwise(x[2]), None
        case "seeded":
            fits = (x[0]["den"] == 1) & x[0]["num"].between(0, 2**32 - 1)
            return F.when(fits, seeded(tag, seed, args[0], x[0]["num"])), domain(~fits)
    raise ValueError(f"unknown operation {op}")


def evaluated(rows: DataFrame, nodes: dict[str, tuple], outputs: list[str], seed: int = 0, tag: bytes = b"") -> DataFrame:
    """rows with a column for each output node and `error`: null, domain (division by zero, a modulus or index that does
    not fit) or precision (a numerator beyond 2 ** 53 - 1 or a denominator beyond 10 ** 12), of the first node that fails."""
    kinds, own, failing = ordered_kinds(nodes), rows, []
    for name, kind in kinds.items():
        op, *args = nodes[name]
        operands = _operands(nodes[name])
        value, wrong = _column(op, args, [F.col(f"_v_{a}") for a in operands], [kinds[a] for a in operands], tag, seed)
        own = own.withColumn(f"_v_{name}", value)
        if op in ("literal", "column", "add", "subtract", "multiply", "divide", "modulo", "seeded"):
            v, given = F.col(f"_v_{name}"), F.lit(True)
            for a in operands:
                given = given & (F.col(f"_v_{a}.x").isNotNull() & F.col(f"_v_{a}.y").isNotNull() if kinds[a] == "V" else F.col(f"_v_{a}").isNotNull())
            if op == "column":
                given = F.col(args[0]).isNotNull()
            lost = (v["x"].isNull() | v["y"].isNull()) if kind == "V" else v.isNull()
            precision = F.when(given & lost, "precision")
            own = own.withColumn(f"_e_{name}", precision if wrong is None else F.coalesce(wrong, precision))
            failing.append(f"_e_{name}")
    own = own.withColumn("error", F.coalesce(*failing) if failing else F.lit(None).cast("string"))
    return own.select(*rows.columns, *(F.when(F.col("error").isNull(), F.col(f"_v_{n}")).alias(n) for n in outputs), "error")


def bound(value: Column, low: int, high: int) -> Column:
    """A scalar within [low, high] as a whole number, halves away from zero; null beyond. Bounds hold before rounding."""
    n, d = _wide(value["num"]), _wide(value["den"])
    size = _whole(F.abs(n) * 2 + d, d * 2).cast("long")
    return F.when((n >= d * low) & (n <= d * high), F.when(n < 0, -size).otherwise(size))
