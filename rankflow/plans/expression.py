"""The postfix expression language: <op> ^ <op> ... [> <output>], read into one logical plan.

Every operator takes relations off a stack and puts one back. The text is split at ^ and > outside quotes and
parentheses, and everything is checked before anything runs. @file stands for the expression in a file.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import SparkSession

from rankflow.operators import filtering, joins, ordering, projection, reduction
from rankflow.relation import Relation
from rankflow.sources.readers import endless, open_uri
from rankflow.sources.writers import write_uri


def split(text: str, mark: str) -> list[str]:
    """Parts between marks that stand outside quotes and parentheses."""
    parts, depth, quote = [""], 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == mark and depth == 0:
            parts.append("")
            continue
        parts[-1] += c
    if depth or quote:
        raise ValueError(f"a parenthesis or quote is left open: {text!r}")
    return [p.strip() for p in parts]


def tokens(text: str) -> tuple[list[str], str | None]:
    """(operators, output)."""
    parts = split(text, ">")
    if len(parts) > 2:
        raise ValueError("more than one output")
    return [t for t in split(parts[0], "^") if t], parts[1] if len(parts) == 2 else None


def _args(text: str, least: int, most: int) -> list[str]:
    found = [a for a in split(text, ",")] if text.strip() else []
    if not least <= len(found) <= most:
        raise ValueError(f"{least} to {most} arguments are needed: {text!r}")
    return found


def _number(text: str) -> int:
    if not re.fullmatch(r"\d+", text):
        raise ValueError(f"not a number: {text!r}")
    return int(text)


def evaluate(spark: SparkSession, text: str, tables: dict[str, Relation] | None = None, write: bool = True) -> Relation:
    """The relation of an expression; its output, if it names one, is written."""
    if text.startswith("@"):
        text = " ".join(r.value for r in spark.read.text(text[1:].strip()).collect())  # an expression, not data
    listed, output = tokens(text)
    stack: list[Relation] = []

    def pop(n: int = 1) -> list[Relation]:
        if len(stack) < n:
            raise ValueError(f"{n} inputs are needed, there are {len(stack)}")
        out = stack[len(stack) - n :]
        del stack[len(stack) - n :]
        return out

    def direction(a: str) -> str:
        if a not in ("+", "-"):
            raise ValueError(f"+ or - is needed: {a!r}")
        return a

    named: dict[str, Callable[[str], Relation]] = {
        "Sort": lambda a: ordering.sort(*pop(), direction(a or "+")),
        "Reduce": lambda a: reduction.reduce(*pop()),
        "Where": lambda a: filtering.where(*pop(), a),
        "ToTable": lambda a: projection.to_table(*pop(), *_args(a, 1, 2)),
        "ToCount": lambda a: projection.to_count(*pop(), *_args(a, 1, 2)),
        "ToLine": lambda a: projection.to_line(*pop(), *_args(a, 1, 1)),
        "Head": lambda a: ordering.head(*pop(), _number(a)),
        "Random": lambda a: ordering.random(*pop(), *map(_number, _args(a, 1, 2))),
        "About": lambda a: _described(*pop()),
        "InnerJoin": lambda a: joins.inner_join(*pop(2)),
        "LeftOuterJoin": lambda a: joins.left_outer_join(*pop(2)),
        "FilterByRight": lambda a: joins.filter_by_right(*pop(2)),
        "FilterNotRight": lambda a: joins.filter_not_right(*pop(2)),
        "Merge": lambda a: (lambda n, d: joins.merge(direction(d), *pop(_number(n))))(*(_args(a, 1, 2) + ["+"])[:2]),
        "Concat": lambda a: joins.concat(*pop(_number(a))),
        "Filter": lambda a: filtering.user_filter(*pop(), a),
        "Apply": lambda a: filtering.user_operator(*pop(), a),
    }
    for place, token in enumerate(listed):
        m = re.fullmatch(r"(\w+)\s*(?:\((.*)\))?", token, re.DOTALL)
        if m and m[1] in named and (m[2] is not None or m[1] in ("Sort", "Reduce", "About", "InnerJoin", "LeftOuterJoin", "FilterByRight", "FilterNotRight")):
            stack.append(named[m[1]](m[2] or ""))
        elif token.endswith(".py") and stack:  # a user filter in a file
            filtering.load_filter("\n".join(r.value for r in spark.read.text(token).coalesce(1).collect()), token)
            stack.append(filtering.user_filter(*pop(), token))
        elif re.fullmatch(r"'[^']*'", token):
            stack.append(filtering.key_query(*pop(), token[1:-1]))
        elif tables and token in tables:
            stack.append(tables[token])
        elif token in ("null", "null0"):
            if not any(t.startswith("Head(") for t in listed[place + 1 :]):
                raise ValueError(f"{token} never ends: a Head has to follow")
            stack.append(endless(spark, fixed=token == "null0"))
        elif m and m[2] is not None:
            raise ValueError(f"no operator {m[1]!r}")
        else:
            stack.append(open_uri(spark, token))
    if len(stack) != 1:
        raise ValueError(f"the expression leaves {len(stack)} relations")
    if output and write:
        write_uri(stack[0], output)
    return stack[0]


def _described(r: Relation) -> Relation:
    return Relation(reduction.about(r), ("name",), "table", r.name)
