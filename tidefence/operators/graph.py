"""Basic graph patterns over a triple table, as joins.

``triples`` has the columns s, p, o, datatype: names as plain text, datatype null for names and blank nodes and else the literal's type. A pattern is a
triple of terms; a term is a ``Var``, a name, or a ``Literal``. Patterns are joined in the order of how many triples they select, smallest first, each one
sharing a variable with what is joined already; the counts come from one aggregation of the triples that any pattern selects. Every join is an equality on
all shared variables, so Catalyst picks broadcast or shuffle by measured size and AQE splits hot keys. Patterns that share no variable would be a
cross join and are refused.

A name and a literal of the same text are different terms, and so are literals of different types: a variable carries both parts, and both must agree.

Cases: nulls in s, p or o are no triples. Repeated triples count once, as a graph is a set. A variable twice in a pattern must agree there too. No pattern, an unknown variable in a bind
or a second meaning for a variable is an error. Other columns of triples are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ModelError

XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = XSD_STRING


Term = Var | Literal | str
Pattern = tuple[Term, Term, Term]
Binding = Callable[[Mapping[str, Column]], Column]


def _type_name(var: str) -> str:
    return f"{var}^type"


def variables(patterns: Sequence[Pattern]) -> list[str]:
    """Names of all variables, in the order of their first appearance."""
    return list(dict.fromkeys(t.name for p in patterns for t in p if isinstance(t, Var)))


def _fits(pattern: Pattern) -> Column:
    """Whether a triple has the pattern's fixed terms, and equal terms where a variable comes twice."""
    tests, seen = [F.lit(True)], {}
    for c, term in zip("spo", pattern, strict=True):
        if isinstance(term, Literal) and c != "o":
            raise ModelError("a literal can only be an object")
        if isinstance(term, Var):
            if term.name in seen:
                tests.append(F.col(c) == F.col(seen[term.name]))
                if c == "o":
                    tests.append(F.col("datatype").isNull())
            seen[term.name] = c
        else:
            tests.append(F.col(c) == (term.value if isinstance(term, Literal) else term))
            if c == "o":
                tests.append(F.col("datatype") == term.datatype if isinstance(term, Literal) else F.col("datatype").isNull())
    return reduce(lambda a, b: a & b, tests)


def _rows(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """A column for each variable; a second one for its datatype where it stands as an object."""
    columns = {}
    for c, term in zip("spo", pattern, strict=True):
        if isinstance(term, Var) and term.name not in columns:
            columns[term.name] = F.col(c).alias(term.name)
            if c == "o":
                columns[_type_name(term.name)] = F.col("datatype").alias(_type_name(term.name))
    return triples.filter(_fits(pattern)).select(*(columns.values() or [F.lit(True).alias("^held")])).distinct()


def _typed(df: DataFrame, var: str) -> Column | None:
    return df[f"`{_type_name(var)}`"] if _type_name(var) in df.columns else None


def _joined(left: DataFrame, right: DataFrame, shared: Sequence[str], how: str) -> DataFrame:
    on = []
    for v in shared:
        on.append(left[f"`{v}`"] == right[f"`{v}`"])
        a, b = _typed(left, v), _typed(right, v)
        if a is not None and b is not None:
            on.append(a.eqNullSafe(b))
        elif a is not None or b is not None:
            on.append((b if a is None else a).isNull())  # a subject or predicate is no literal
    both = left.join(right, reduce(lambda a, b: a & b, on), how)
    gone = [right[f"`{v}`"] for v in shared] + [_typed(right, v) for v in shared if _typed(right, v) is not None]
    return both.drop(*gone)


def _order(patterns: Sequence[Pattern], counts: Sequence[int], known: set[str]) -> list[int]:
    """Smallest first, each next one sharing a variable with those before."""
    left, out = set(range(len(patterns))), []
    while left:
        near = [i for i in left if not known or known & set(variables([patterns[i]])) or not variables([patterns[i]])]
        if not near:
            names = ", ".join(sorted(variables([patterns[i] for i in left])))
            raise ModelError(f"patterns of {names} share no variable with the others")
        best = min(near, key=lambda i: (counts[i], i))
        out.append(best)
        left.remove(best)
        known = known | set(variables([patterns[best]]))
    return out


def pattern_counts(triples: DataFrame, patterns: Sequence[Pattern]) -> list[int]:
    """How many triples each pattern selects, in one pass; one row reaches the driver."""
    counted = triples.agg(*[F.count_if(_fits(p)).alias(f"n{i}") for i, p in enumerate(patterns)]).first()
    return [counted[i] for i in range(len(patterns))]


@dataclass(frozen=True)
class GraphQuery:
    """Patterns that must hold, groups of patterns that may, values computed from variables, tests, and what is returned."""

    patterns: Sequence[Pattern]
    optional: Sequence[Sequence[Pattern]] = ()
    binds: Mapping[str, Binding] = field(default_factory=dict)
    filters: Sequence[Binding] = ()
    select: Sequence[str] | None = None
    distinct: bool = False


def match(triples: DataFrame, query: GraphQuery) -> DataFrame:
    """A row for each solution, with a column for each selected variable (all by default); unmatched optional variables are null."""
    if not query.patterns:
        raise ModelError("a graph query needs a pattern")
    t = triples.filter(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull())
    out = _solutions(t, query.patterns, None)
    for group in query.optional:
        inside = set(out.columns) & set(variables(group))
        if not inside:
            raise ModelError("an optional group needs a variable of the patterns")
        out = _joined(out, _solutions(t, group, None), sorted(inside), "left")
    for name, bind in query.binds.items():
        if name in out.columns:
            raise ModelError(f"variable {name!r} has a meaning already")
        out = out.withColumn(name, bind(_Columns(out)))
    for test in query.filters:
        out = out.filter(test(_Columns(out)))
    names = list(query.select) if query.select is not None else [c for c in out.columns if "^" not in c]
    if missing := [n for n in names if n not in out.columns]:
        raise ModelError(f"unknown variables: {', '.join(missing)}")
    out = out.select(*[F.col(f"`{n}`") for n in names])
    return out.distinct() if query.distinct else out


class _Columns(Mapping):
    """The columns of solutions by variable."""

    def __init__(self, df: DataFrame) -> None:
        self._names = [c for c in df.columns if "^" not in c]

    def __getitem__(self, name: str) -> Column:
        if name not in self._names:
            raise ModelError(f"unknown variable: {name}")
        return F.col(f"`{name}`")

    def __iter__(self):
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def _solutions(t: DataFrame, patterns: Sequence[Pattern], known: set[str] | None) -> DataFrame:
    counts = pattern_counts(t, patterns) if len(patterns) > 1 else [0]
    order = _order(patterns, counts, known or set())
    out = _rows(t, patterns[order[0]])
    for i in order[1:]:
        right = _rows(t, patterns[i])
        shared = [v for v in variables([patterns[i]]) if v in out.columns]
        if shared:
            out = _joined(out, right, shared, "inner")
        elif not variables([patterns[i]]):
            # a triple without variables holds or does not
            out = out if counts[i] else out.limit(0)
        else:
            out = out.join(right)  # only a pattern without variables, so one row at most, stands before
    return out.drop("^held")
