"""Small pieces of SQL over the positions array, shared by features and tags."""

from __future__ import annotations

import itertools
import re

_names = itertools.count()


def fresh(stem: str = "s") -> str:
    return f"{stem}{next(_names)}"


def bit(mask: str, square: str) -> str:
    return f"(getbit({mask}, {square}) = 1)"


def once(mask: str, body) -> str:
    """``body`` of a mask that is looked at for each square: computed once, if it is more than a name."""
    return body(mask) if re.fullmatch(r"[\w.$]+", mask) else let(mask, body)


def squares(mask: str) -> str:
    v = fresh()
    return once(mask, lambda m: f"filter(sequence(0, 63), {v} -> {bit(m, v)})")


def some(mask: str, test) -> str:
    """Whether any square of a mask passes ``test(square)``."""
    v = fresh()
    return once(mask, lambda m: f"exists(sequence(0, 63), {v} -> {bit(m, v)} AND ({test(v)}))")


def count(mask: str, test) -> str:
    v = fresh()
    return once(mask, lambda m: f"size(filter(sequence(0, 63), {v} -> {bit(m, v)} AND ({test(v)})))")


def total(mask: str, amount) -> str:
    v, a = fresh(), fresh("a")
    return f"aggregate({squares(mask)}, 0, ({a}, {v}) -> {a} + cast({amount(v)} AS int))"


def file(square: str) -> str:
    return f"(({square}) % 8)"


def rank(square: str) -> str:
    return f"(({square}) div 8)"


def value(piece: str) -> str:
    return f"element_at(array(0, 1, 3, 3, 5, 9, 0), abs({piece}) + 1)"


def king_value(piece: str) -> str:
    return f"element_at(array(0, 1, 3, 3, 5, 9, 99), abs({piece}) + 1)"


def distance(a: str, b: str) -> str:
    return f"greatest(abs({file(a)} - {file(b)}), abs({rank(a)} - {rank(b)}))"


def between(x: str, a: str, b: str) -> str:
    """Whether ``x`` lies strictly between two squares of one line."""
    df, dr = f"({file(b)} - {file(a)})", f"({rank(b)} - {rank(a)})"
    on_line = f"({df} = 0 OR {dr} = 0 OR abs({df}) = abs({dr}))"
    same = f"(({file(x)} - {file(a)}) * {dr} = ({rank(x)} - {rank(a)}) * {df})"
    inside = " AND ".join(f"{g(x)} BETWEEN least({g(a)}, {g(b)}) AND greatest({g(a)}, {g(b)})" for g in (file, rank))
    return f"({x} <> {a} AND {x} <> {b} AND {on_line} AND {same} AND {inside})"


def collinear(a: str, b: str, c: str) -> str:
    def same(g):
        return f"({g(a)} = {g(b)} AND {g(b)} = {g(c)})"

    return "(" + " OR ".join(same(g) for g in (rank, file, lambda s: f"({rank(s)} - {file(s)})", lambda s: f"({rank(s)} + {file(s)})")) + ")"


def bind(value_: str, v: str, body: str) -> str:
    """``body`` with the name ``v`` for a value: a fold of nothing that starts with it and ends in ``body``. The element of an
    array of one would do as well, but asks for its type each time, and so for the types of all that is nested in it."""
    return f"aggregate(cast(array() AS array<int>), {value_}, (kept, none) -> kept, {v} -> {body})"


def let(value_: str, body) -> str:
    """``body`` of a name for a value."""
    v = fresh("v")
    return bind(value_, v, body(v))
