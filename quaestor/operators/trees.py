"""Rule trees as tokens in postfix order: numbers of facts, and not, and, or, if (condition, then, otherwise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How many values an operator takes from the stack.
ARITY = {"not": 1, "and": 2, "or": 2, "if": 3}
PLAIN = {"not": "NOT ({0})", "and": "({0}) AND ({1})", "or": "({0}) OR ({1})", "if": "if ({0}), require ({1}); otherwise require ({2})"}


def _folded(tokens: Column, kind: str, leaf, made) -> Column:
    """A fold over the tokens with a stack; `made(operator, values)` is what an operator leaves there."""

    def step(stack, token):
        out = F.concat(stack, F.array(leaf(token.try_cast("int"))))
        for name, n in ARITY.items():
            values = [F.get(stack, F.size(stack) - n + i) for i in range(n)]
            rest = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - n, F.lit(0)))
            out = F.when(token == name, F.concat(rest, F.array(made(name, values)))).otherwise(out)
        return out

    return F.get(F.aggregate(tokens, F.array().cast(f"array<{kind}>"), step), F.lit(0))


def truth(tokens: Column, facts: Column) -> Column:
    """What a tree says of an array of facts."""
    said = {"not": lambda v: ~v[0], "and": lambda v: v[0] & v[1], "or": lambda v: v[0] | v[1], "if": lambda v: F.when(v[0], v[1]).otherwise(v[2])}
    return _folded(tokens, "boolean", lambda i: F.get(facts, i), lambda name, v: said[name](v))


def text(tokens: Column, names: Column, style: dict[str, str] = PLAIN) -> Column:
    """A tree in words; a style has a template with numbered places for each operator."""

    def filled(name, values):
        parts, rest = [], style[name]
        while "{" in rest:
            before, rest = rest.split("{", 1)
            place, rest = rest.split("}", 1)
            parts += [F.lit(before), values[int(place)]]
        return F.concat(*parts, F.lit(rest))

    return _folded(tokens, "string", lambda i: F.get(names, i), filled)


def leaves(tokens: Column) -> Column:
    """The numbers of the facts that a tree names, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(tokens, lambda t: t.rlike("^[0-9]+$")), lambda t: t.cast("int"))))
