"""Formulas: Python expression syntax over fields, numbers and catalog functions.

check() reports what is wrong with a formula and how far back it looks. evaluate() runs any number of formulas over a panel:
equal sub-expressions are computed once, and windows are ordered so that those per entity and those per bar alternate as
seldom as the formulas allow - each alternation is one exchange, whatever the number of functions.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.dsl.catalog import ALIASES, FUNCTIONS, MACROS, Function
from tessella.functions.scalar import ge, gt, le, lt, ratio
from tessella.functions.scalar import eq as eq_
from tessella.llm.scratch import discard
from tessella.operators import cs
from tessella.sources.panel import FIELDS

#: The look-back of what may look back to the first bar.
ENDLESS = 1 << 40
#: Fields that hold the future.
FORBIDDEN = ("resp", "trading_restriction")
_COMPARE = {ast.Gt: gt, ast.GtE: ge, ast.Lt: lt, ast.LtE: le, ast.Eq: eq_}
_INFIX = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: ratio}


class FormulaError(ValueError):
    pass


class _Expand(ast.NodeTransformer):
    """Aliases to names, macros to their bodies, combine_rank and weighted_sum to what they stand for."""

    def visit_Name(self, node: ast.Name) -> ast.expr:
        if node.id in MACROS and not MACROS[node.id][0]:
            return self.visit(parse_raw(MACROS[node.id][1]))
        return node

    def visit_Call(self, node: ast.Call) -> ast.expr:
        if not isinstance(node.func, ast.Name) or node.keywords:
            raise FormulaError("only calls of catalog functions without keywords are allowed")
        args = [self.visit(a) for a in node.args]
        name = ALIASES.get(node.func.id, node.func.id)
        if name in MACROS:
            names, body = MACROS[name]
            if len(names) != len(args):
                raise FormulaError(f"{name} takes {len(names)} arguments, not {len(args)}")
            tree = parse_raw(body)
            given = dict(zip(names, args, strict=True))
            tree = _Replace(given).visit(tree)
            return self.visit(tree)
        if name == "combine_rank":
            return ast.Call(ast.Name("mean_of"), [ast.Call(ast.Name("cs_rank"), [a], []) for a in args], [])
        return ast.Call(ast.Name(name), args, [])


class _Replace(ast.NodeTransformer):
    def __init__(self, given: dict[str, ast.expr]):
        self.given = given

    def visit_Name(self, node: ast.Name) -> ast.expr:
        return self.given.get(node.id, node)


def parse_raw(formula: str) -> ast.expr:
    try:
        return ast.parse(formula.strip(), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"syntax: {e.msg} at {e.offset}") from e


def parse(formula: str) -> ast.expr:
    return _Expand().visit(parse_raw(formula))


def canonical(formula: str) -> str:
    """The formula as it is printed after aliases and macros are expanded."""
    return ast.unparse(ast.fix_missing_locations(parse(formula)))


def number(node: ast.expr) -> float | None:
    try:
        value = ast.literal_eval(node)
    except (ValueError, SyntaxError, TypeError):
        return None
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) else None


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    fields: set[str] = field(default_factory=set)
    functions: set[str] = field(default_factory=set)
    look_back: int = 0  # bars before the current one that the value depends on, ENDLESS if there is no bound

    @property
    def valid(self) -> bool:
        return not self.errors


def check(formula: str, known: tuple[str, ...] = FIELDS) -> Report:
    out = Report()
    try:
        tree = parse(formula)
    except FormulaError as e:
        out.errors.append(str(e))
        return out
    out.look_back = _check(tree, out, set(known))
    if out.functions & {"ts_corr", "ts_cov"}:
        out.warnings.append("rolling correlations are noisy")
    if out.functions & {"ifelse", "gt", "ge", "lt", "le", "eq", "and_op", "or_op", "not_op"}:
        out.warnings.append("conditions raise turnover")
    if any(f.startswith("open_") for f in out.fields):
        out.warnings.append("the open of a bar is known only within it")
    return out


def _check(node: ast.expr, out: Report, known: set[str]) -> int:
    if number(node) is not None:
        return 0
    match node:
        case ast.Name(id=name):
            if name in FORBIDDEN:
                out.errors.append(f"{name} holds the future")
            elif name not in known:
                out.errors.append(f"unknown field {name}")
            out.fields.add(name)
            return 0
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _INFIX:
            return max(_check(a, out, known), _check(b, out, known))
        case ast.UnaryOp(op=ast.USub() | ast.UAdd(), operand=a):
            return _check(a, out, known)
        case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
            out.functions.add("gt")
            return max(_check(a, out, known), _check(b, out, known))
        case ast.Call(func=ast.Name(id="weighted_sum"), args=args):
            if len(args) % 2 or not args or any(number(w) is None for w in args[::2]):
                out.errors.append("weighted_sum takes pairs of a number and a series")
            return max([_check(a, out, known) for a in args[1::2]], default=0)
        case ast.Call(func=ast.Name(id=name), args=args):
            f = FUNCTIONS.get(name)
            if f is None:
                out.errors.append(f"unknown function {name}")
                return 0
            out.functions.add(name)
            series = args if f.series < 0 else args[: f.series]
            numbers = [] if f.series < 0 else args[f.series :]
            if f.series < 0 and not args or f.series >= 0 and not (f.series + len(f.numbers) - len(f.defaults) <= len(args) <= f.series + len(f.numbers)):
                out.errors.append(f"{name} takes {f.series} series and {len(f.numbers)} numbers")
                return 0
            values = [number(x) for x in numbers]
            if any(v is None for v in values):
                out.errors.append(f"{name}: numbers must be literal")
                return 0
            back = 0
            if f.window is not None:
                window = ([*values, *f.defaults] or [1])[0]
                if window <= 0 or window != int(window):
                    out.errors.append(f"{name}: the window must be a positive whole number")
                    return 0
                from tessella.operators.ts import ema_reach, ewm_reach

                reach = {"ts_ema_at": ema_reach, "ts_ewm_at": ewm_reach}.get(name)
                back = int(window) if name in ("lag", "delta", "ts_pct_change") else reach(window) if reach else int(window) - 1
            if name == "ts_carry":
                back = ENDLESS
            return min(ENDLESS, back + max(_check(a, out, known) for a in series))
    out.errors.append(f"not allowed here: {ast.unparse(node)}")
    return 0


class _Stages:
    def __init__(self, df: DataFrame, only: Column | None = None, used: list[DataFrame] | None = None):
        self.df, self.only, self.used = df, only, used
        self.tables: list[DataFrame] = []  # of large ranks, that df reads
        self.columns: dict[str, Column] = {}  # printed node -> a column without window functions
        self.pending: dict[str, tuple[ast.Call, Function]] = {}
        self.n = 0

    def column(self, node: ast.expr) -> Column | None:
        """The node's column, or None while a window that it needs is pending."""
        if (value := number(node)) is not None:
            return F.lit(float(value))
        key = ast.unparse(node)
        if key in self.columns:
            return self.columns[key]
        match node:
            case ast.Name(id=name):
                return F.col(name)
            case ast.BinOp(left=a, op=op, right=b):
                return self._apply(_INFIX[type(op)], [a, b])
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return self._apply(lambda x: -x, [a])
            case ast.UnaryOp(operand=a):
                return self.column(a)
            case ast.Compare(left=a, ops=[op], comparators=[b]):
                return self._apply(_COMPARE[type(op)], [a, b])
            case ast.Call(func=ast.Name(id="weighted_sum"), args=args):
                from tessella.functions.scalar import weighted_sum

                weights = [number(w) for w in args[::2]]
                return self._apply(lambda *xs: weighted_sum(weights, list(xs)), args[1::2])
            case ast.Call(func=ast.Name(id=name), args=args):
                f = FUNCTIONS[name]
                series = args if f.series < 0 else args[: f.series]
                if f.kind == "scalar":
                    return self._apply(lambda *xs: f.build(*xs, *self._numbers(f, args)), series)
                for a in series:  # what is below must come first
                    self.column(a)
                self.pending[key] = (node, f)
                return None
        raise FormulaError(f"not allowed here: {ast.unparse(node)}")

    def _apply(self, build, nodes: list[ast.expr]) -> Column | None:
        got = [self.column(a) for a in nodes]
        return None if any(g is None for g in got) else build(*got)

    def _numbers(self, f: Function, args: list[ast.expr]) -> list:
        given = [number(x) for x in args[f.series :]] if f.series >= 0 else []
        values = given + list(f.defaults)[len(f.defaults) - (len(f.numbers) - len(given)) :] if len(given) < len(f.numbers) else given
        return [int(v) if name == "window" else float(v) for name, v in zip(f.numbers, values, strict=True)]

    def _ready(self, kind: str) -> dict[str, Column]:
        out = {}
        for key, (node, f) in self.pending.items():
            if f.kind == kind:
                got = [self.columns_of(a) for a in node.args[: f.series]]
                if all(g is not None for g in got):
                    out[key] = f.build(*got, *self._numbers(f, node.args))
        return out

    def columns_of(self, node: ast.expr) -> Column | None:
        held, self.pending = self.pending, dict(self.pending)
        got = self.column(node)
        self.pending = held
        return got

    def run(self, roots: list[ast.expr]) -> None:
        for r in roots:
            self.column(r)
        kind = "ts"
        while self.pending:
            ready = self._ready(kind)
            if not ready:
                kind = "cs" if kind == "ts" else "ts"
                ready = self._ready(kind)
                if not ready:
                    raise FormulaError("windows depend on each other")
            names = {key: f"_w{self.n + k}" for k, key in enumerate(ready)}
            self.n += len(ready)
            ranks = {key: (f.build, self.columns_of(node.args[0])) for key, (node, f) in self.pending.items() if key in ready and f.build in cs.RANKS}
            self.df = self.df.withColumns({names[key]: c for key, c in ready.items() if key not in ranks})
            if ranks:
                last = len(ready) == len(self.pending)
                made: list[DataFrame] = []
                self.df = cs.with_ranks(self.df, {names[key]: r for key, r in ranks.items()}, only=self.only if last else None, used=made)
                if made:  # it has been written, so what it was made of can go
                    discard(*self.tables)
                    self.tables = made
                if last and self.used is not None:
                    self.used += made
            for key in ready:
                self.columns[key] = F.col(names[key])
                del self.pending[key]


def evaluate(panel: DataFrame, formulas: dict[str, str], keep: tuple[str, ...] | None = None, only: Column | None = None, used: list[DataFrame] | None = None, tables: list[DataFrame] | None = None) -> DataFrame:
    """panel, or its columns to keep, with a column for each formula. Raises FormulaError if one fails check(). only: the rows wanted back, a condition on columns to keep.
    used: to it is added the table, if any, that the result only reads row by row, as it ends with large ranks; to tables
    the table of large ranks that it reads, wherever they come."""
    trees = {}
    for name, formula in formulas.items():
        report = check(formula, tuple(panel.columns))
        if not report.valid:
            raise FormulaError(f"{name}: {'; '.join(report.errors)}")
        trees[name] = parse(formula)
    kept = panel.columns
    if keep is not None:  # what large ranks write has no more than is asked for
        read = {n.id for tree in trees.values() for n in ast.walk(tree) if isinstance(n, ast.Name)} | {"security_id", "bar_idx"}
        kept = [c for c in panel.columns if c in keep]
        panel = panel.select(*(c for c in panel.columns if c in keep or c in read))
    stages = _Stages(panel, only, used)
    stages.run(list(trees.values()))
    if tables is not None:
        tables += stages.tables
    out = stages.df.withColumns({name: stages.column(tree).cast("double") for name, tree in trees.items()})
    return (out if only is None else out.filter(only)).select(*kept, *formulas)


def grid(template: str, **choices: list) -> dict[str, str]:
    """All instances of a template such as "ts_mean({f}, {n})", by name."""
    from itertools import product

    out = {}
    for values in product(*choices.values()):
        given = dict(zip(choices, values, strict=True))
        out["_".join(str(v) for v in values)] = template.format(**given)
    return out
