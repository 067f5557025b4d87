"""Conditions written as Python expressions over columns, compiled to Spark columns.

The text is parsed, never run: its syntax tree is turned into a Column, so the condition is optimised,
pushed into scans and compiled with the rest of the plan. What has no counterpart raises Unsupported;
callers may then opt into a row-wise Python function."""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_CASTS = {"pos1": "int", "pos2": "int", "mapq1": "int", "mapq2": "int"}
SPARK_TYPES = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}


class Unsupported(ValueError):
    pass


def wildcard_regex(pattern: str) -> str:
    """A shell pattern (* ? [..] [!..]) as a regular expression for a whole text."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body = pattern[i:end]
            negated = body.startswith("!")
            body = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            body = "\\" + body if body.startswith("^") else body
            out.append(f"[{'^' * negated}{body}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "".join(out)


def full_match(text: Column, regex: str) -> Column:
    return text.rlike(f"\\A(?:{regex})\\z")


class _Compiler:
    COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}

    def __init__(self, columns: Sequence[str], casts: Mapping[str, str]):
        self.columns, self.casts = list(columns), {**DEFAULT_CASTS, **casts}

    # Every method gives (column or Python value, kind): kind is int, float, str, bool or list.
    def visit(self, node: ast.expr):
        method = getattr(self, f"on_{type(node).__name__}", None)
        if method is None:
            raise Unsupported(f"{type(node).__name__} in a condition")
        return method(node)

    def column(self, name: str):
        kind = self.casts.get(name, "str")
        if kind not in SPARK_TYPES:
            raise Unsupported(f"type {kind!r} of {name}")
        return F.col(f"`{name}`").cast(SPARK_TYPES[kind]), kind

    def on_Name(self, node):
        if node.id in self.columns:
            return self.column(node.id)
        raise Unsupported(f"unknown name {node.id!r}")

    def on_Constant(self, node):
        v = node.value
        for kind in (bool, int, float, str):
            if isinstance(v, kind):
                return F.lit(v), kind.__name__
        raise Unsupported(f"constant {v!r}")

    def truth(self, node) -> Column:
        c, kind = self.visit(node)
        if kind == "bool":
            return c
        if kind == "str":
            return F.length(c) > 0
        if kind in ("int", "float"):
            return c != 0
        raise Unsupported("truth of a list")

    def on_BoolOp(self, node):
        # Python gives back an operand; only its truth matters unless all are truth values
        values = [self.truth(v) for v in node.values]
        out = values[0]
        for v in values[1:]:
            out = (out & v) if isinstance(node.op, ast.And) else (out | v)
        return out, "bool"

    def on_UnaryOp(self, node):
        if isinstance(node.op, ast.Not):
            return ~self.truth(node.operand), "bool"
        c, kind = self.number(node.operand)
        if isinstance(node.op, ast.USub):
            return -c, kind
        if isinstance(node.op, ast.UAdd):
            return c, kind
        raise Unsupported("~ in a condition")

    def number(self, node):
        c, kind = self.visit(node)
        if kind == "bool":
            return c.cast("bigint"), "int"
        if kind not in ("int", "float"):
            raise Unsupported(f"arithmetic on {kind}")
        return c, kind

    def on_BinOp(self, node):
        if isinstance(node.op, ast.Add):
            a, ka = self.visit(node.left)
            b, kb = self.visit(node.right)
            if ka == kb == "str":
                return F.concat(a, b), "str"
        if isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            a, b = self.visit(node.left), self.visit(node.right)
            if a[1] == b[1] == "bool":
                return ((a[0] & b[0]) if isinstance(node.op, ast.BitAnd) else (a[0] | b[0])), "bool"
        (a, ka), (b, kb) = self.number(node.left), self.number(node.right)
        kind = "float" if "float" in (ka, kb) else "int"
        op = node.op
        if isinstance(op, ast.Add):
            return a + b, kind
        if isinstance(op, ast.Sub):
            return a - b, kind
        if isinstance(op, ast.Mult):
            return a * b, kind
        if isinstance(op, ast.Div):
            return a.cast("double") / b.cast("double"), "float"
        if isinstance(op, ast.Mod):  # the sign of the divisor, as in Python
            return ((a % b) + b) % b, kind
        if isinstance(op, ast.FloorDiv):
            if kind == "float":
                return F.floor(a / b).cast("double"), kind
            return F.floor((a - (((a % b) + b) % b)) / b).cast("bigint"), "int"
        if isinstance(op, ast.Pow):
            out = F.pow(a.cast("double"), b.cast("double"))
            return (out.cast("bigint"), "int") if kind == "int" else (out, "float")
        raise Unsupported(f"operator {type(op).__name__}")

    def on_Compare(self, node):
        out = None
        left = node.left
        for op, right in zip(node.ops, node.comparators):
            if isinstance(op, (ast.In, ast.NotIn)):
                c = self.contains(left, right)
                c = ~c if isinstance(op, ast.NotIn) else c
            else:
                (a, ka), (b, kb) = self.visit(left), self.visit(right)
                if type(op) not in self.COMPARE:
                    raise Unsupported("'is' in a condition")
                if (ka == "str") != (kb == "str"):
                    if isinstance(op, (ast.Eq, ast.NotEq)):  # text never equals a number
                        c = F.lit(isinstance(op, ast.NotEq))
                    else:
                        raise Unsupported("order between text and a number; cast the column")
                else:
                    if "bool" in (ka, kb) and ka != kb:
                        a, b = (x.cast("bigint") if k == "bool" else x for x, k in ((a, ka), (b, kb)))
                    c = getattr(a, self.COMPARE[type(op)])(b)
            out = c if out is None else out & c
            left = right
        return out, "bool"

    def contains(self, item, container) -> Column:
        c, kind = self.visit(item)
        if isinstance(container, (ast.List, ast.Tuple, ast.Set)):
            members = [self.visit(e) for e in container.elts]
            same = [m for m, k in members if (k == "str") == (kind == "str")]
            return c.isin(*same) if same else F.lit(False)
        text, other = self.visit(container)
        if kind == other == "str":
            return F.contains(text, c)
        raise Unsupported("'in' over something else than literals or text")

    def on_IfExp(self, node):
        (a, ka), (b, kb) = self.visit(node.body), self.visit(node.orelse)
        if ka != kb and not {ka, kb} <= {"int", "float"}:
            raise Unsupported("branches of different types")
        return F.when(self.truth(node.test), a).otherwise(b), ka if ka == kb else "float"

    def on_Subscript(self, node):
        if isinstance(node.value, ast.Name) and node.value.id == "COLS" and "COLS" not in self.columns:
            i = self.whole(node.slice)
            return F.col(f"`{self.columns[i]}`").cast("string"), "str"
        text, kind = self.visit(node.value)
        if kind != "str":
            raise Unsupported("subscript of something else than text")
        n = F.length(text)
        if isinstance(node.slice, ast.Slice):
            if node.slice.step is not None:
                raise Unsupported("slice with a step")
            start = 0 if node.slice.lower is None else self.whole(node.slice.lower)
            lo = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
            if node.slice.upper is None:
                hi = n
            else:
                stop = self.whole(node.slice.upper)
                hi = F.lit(stop) if stop >= 0 else n + stop
            return F.substring(text, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")), "str"
        i = self.whole(node.slice)
        return F.substring(text, F.lit(i + 1) if i >= 0 else (n + i + 1).cast("int"), F.lit(1)), "str"

    @staticmethod
    def whole(node) -> int:
        try:
            v = ast.literal_eval(node)
        except ValueError as e:
            raise Unsupported("an index that is no literal") from e
        if not isinstance(v, int):
            raise Unsupported("an index that is no whole number")
        return v

    @staticmethod
    def literal(node) -> str:
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return node.value
        raise Unsupported("a pattern that is no literal")

    def on_Call(self, node):
        if node.keywords and not (isinstance(node.func, ast.Name) and node.func.id == "region_match"):
            raise Unsupported("keyword arguments")
        if isinstance(node.func, ast.Attribute):
            return self.text_method(node)
        if not isinstance(node.func, ast.Name):
            raise Unsupported("this call")
        name, args = node.func.id, node.args
        if name == "csv_match":
            c, _ = self.visit(args[0])
            return c.cast("string").isin(*self.literal(args[1]).split(",")), "bool"
        if name == "wildcard_match":
            return full_match(self.visit(args[0])[0], wildcard_regex(self.literal(args[1]))), "bool"
        if name == "regex_match":
            pattern = self.literal(args[1])
            if re.search(r"\(\?P|\(\?\(|\\Z|\\[UuNx]\{", pattern):
                raise Unsupported("regular expression syntax that differs between the dialects")
            re.compile(pattern)
            return full_match(self.visit(args[0])[0], pattern), "bool"
        if name == "region_match":
            named = {k.arg: k.value for k in node.keywords}
            order = ["chrom", "pos", "region_chrom", "region_start", "region_end"]
            given = dict(zip(order, args)) | named
            chrom, pos = self.visit(given["chrom"])[0], self.number(given["pos"])[0]
            out = chrom == self.visit(given["region_chrom"])[0]
            for edge, test in (("region_start", pos.__ge__), ("region_end", pos.__le__)):
                if edge in given:
                    bound = self.number(given[edge])[0]
                    inside = test(bound)
                    out = out & (inside if edge == "region_start" else (bound == -1) | inside)
            return out, "bool"
        if name in ("int", "float", "str", "bool") and len(args) == 1:
            if name == "bool":
                return self.truth(args[0]), "bool"
            c, _ = self.visit(args[0])
            return (F.trim(c) if name != "str" else c).cast(SPARK_TYPES[name]), name
        if name == "abs":
            c, kind = self.number(args[0])
            return F.abs(c), kind
        if name == "len":
            c, kind = self.visit(args[0])
            if kind == "str":
                return F.length(c), "int"
        if name in ("min", "max") and len(args) > 1:
            values = [self.visit(a) for a in args]
            kinds = {k for _, k in values}
            if len(kinds) == 1 or kinds <= {"int", "float"}:
                f = F.least if name == "min" else F.greatest
                return f(*[v for v, _ in values]), kinds.pop() if len(kinds) == 1 else "float"
        raise Unsupported(f"call of {name!r}")

    def text_method(self, node):
        c, kind = self.visit(node.func.value)
        if kind != "str":
            raise Unsupported(f"method {node.func.attr!r} of {kind}")
        name, args = node.func.attr, node.args
        if name in ("startswith", "endswith"):
            options = args[0].elts if isinstance(args[0], ast.Tuple) else [args[0]]
            tests = [getattr(c, name)(self.visit(o)[0]) for o in options]
            out = tests[0]
            for t in tests[1:]:
                out = out | t
            return out, "bool"
        if name in ("upper", "lower") and not args:
            return getattr(F, name)(c), "str"
        if name in ("strip", "lstrip", "rstrip") and not args:
            return {"strip": F.trim, "lstrip": F.ltrim, "rstrip": F.rtrim}[name](c), "str"
        if name == "replace" and len(args) == 2:
            return F.replace(c, self.visit(args[0])[0], self.visit(args[1])[0]), "str"
        raise Unsupported(f"method {name!r}")


def _tree(text: str, columns: Sequence[str]) -> ast.expr:
    return ast.parse(text.strip(), mode="eval").body


def compile_condition(text: str, columns: Sequence[str], casts: Mapping[str, str] | None = None) -> Column:
    """The truth of a condition as a Column; null where a value it needs is null. Columns are text
    unless they are positions, mapping qualities or named in casts."""
    return _Compiler(columns, casts or {}).truth(_tree(text, columns))


def compile_value(text: str, columns: Sequence[str], casts: Mapping[str, str] | None = None) -> Column:
    """The value of an expression as a Column."""
    return _Compiler(columns, casts or {}).visit(_tree(text, columns))[0]


def python_condition(text: str, columns: Sequence[str], casts: Mapping[str, str] | None = None, startup: str | None = None) -> Column:
    """The condition evaluated by Python on Arrow batches. It runs the given code, so callers ask the
    user first; startup is run once for each task."""
    kinds = {**DEFAULT_CASTS, **(casts or {})}
    cols = list(columns)

    @F.pandas_udf(T.BooleanType())
    def run(frame: pd.DataFrame) -> pd.Series:
        import fnmatch

        scope: dict = {
            "csv_match": lambda x, csv: x in csv.split(","),
            "wildcard_match": lambda x, w: fnmatch.fnmatchcase(x, w),
            "regex_match": lambda x, r: re.fullmatch(r, x) is not None,
            "region_match": lambda c, p, rc, s=-1, e=-1: c == rc and p >= s and (e == -1 or p <= e),
        }
        if startup:
            exec(startup, scope)
        code = compile(text.strip(), "condition", "eval")
        convert = {"int": int, "float": float, "str": str, "bool": bool}
        out = []
        for row in frame.itertuples(index=False, name=None):
            names = {c: convert[kinds.get(c, "str")](v) for c, v in zip(cols, row) if v is not None}
            out.append(bool(eval(code, scope, {**names, "COLS": [str(v) for v in row]})))
        return pd.Series(out, dtype=bool)

    return run(F.struct(*[F.col(f"`{c}`") for c in cols]))
