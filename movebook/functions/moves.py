"""Packed moves as Column expressions: origin, destination and promotion in one integer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Promotion pieces by number; 0 is none.
PROMOTIONS = {2: "n", 3: "b", 4: "r", 5: "q"}


def pack(origin: Column, target: Column, promotion: Column) -> Column:
    return origin.bitwiseOR(F.shiftleft(target, 6)).bitwiseOR(F.shiftleft(promotion, 12)).cast("int")


def origin_of(packed: Column) -> Column:
    return packed.bitwiseAND(63).cast("int")


def target_of(packed: Column) -> Column:
    return F.shiftright(packed, 6).bitwiseAND(63).cast("int")


def promotion_of(packed: Column) -> Column:
    return F.shiftright(packed, 12).bitwiseAND(7).cast("int")


def square_name(square: Column) -> Column:
    return F.concat(F.char(F.lit(97) + square.bitwiseAND(7)), (F.shiftright(square, 3) + 1).cast("string"))


def uci_of(packed: Column) -> Column:
    letter = F.lit("")
    for number, name in PROMOTIONS.items():
        letter = F.when(promotion_of(packed) == number, name).otherwise(letter)
    return F.concat(square_name(origin_of(packed)), square_name(target_of(packed)), letter)


def canonical_index(legal: Column, packed: Column) -> Column:
    """Place of a packed move among the sorted legal ones, from 0; null where it is not legal."""
    at = F.array_position(F.array_sort(legal), packed)
    return F.when(at > 0, (at - 1).cast("int"))


def resolve(legal: Column, packed: Column) -> Column:
    """The legal move that is packed so, or null."""
    return F.try_element_at(F.filter(legal, lambda m: m == packed), F.lit(1))
