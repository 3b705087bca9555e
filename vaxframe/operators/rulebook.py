"""Rules as conditions that compile to one bit each.

A group of rules gives a row two longs: ``mask``, where bit i tells that rule i fires, and ``errors``, those of its bits that are
errors.  Where a row's findings end, how many there are and whether any is an error is arithmetic on these.  An entry is
the masks of one group at one place of a message with the values that go into texts; only ``spelled`` turns entries into
findings, and reads severity, segment, field and wording from the rule table.
"""

from __future__ import annotations

from typing import NamedTuple

from ..functions import hl7text as h
from ..functions.rule_texts import TEXTS

WORDS = "array<array<string>>"
ENTRY = f"struct<stage:int,order_no:int,block:int,obx_no:int,grp:int,at:int,mask:bigint,errors:bigint,words:{WORDS}>"
NO_ENTRY = f"cast(array() as array<{ENTRY}>)"


class Rule(NamedTuple):
    """``severity`` is E, W or a condition under which it is E; ``repeat`` is a number, or None for the entry's own ``at``."""

    rule: str
    cond: str
    severity: str
    segment: str
    field: int
    values: tuple[str, ...]
    thrown: bool
    repeat: int | None
    text: str


def finding(rule: str, cond: str, severity: str, segment: str, field: int, *values: str,
            thrown: bool = False, repeat: int | None = 1, text: str | None = None) -> Rule:
    return Rule(rule, cond, severity, segment, field, values, thrown, repeat, TEXTS[text or rule])


class Group:
    """Rules that run over the same row, in their order; at most 62 of them."""

    def __init__(self, number: int, *rules: Rule):
        assert len(rules) < 63
        self.number, self.rules = number, rules
        self.valued = [i for i, r in enumerate(rules) if r.values]

    def bits(self, keep) -> str:
        """The literal whose bits are the rules that ``keep`` accepts."""
        return f"{sum(1 << i for i, r in enumerate(self.rules) if keep(r))}L"

    @property
    def thrown(self) -> str:
        return self.bits(lambda r: r.thrown)

    def mask(self) -> str:
        return "(" + " | ".join(f"case when {r.cond} then {1 << i}L else 0L end" for i, r in enumerate(self.rules)) + ")"

    def cut(self, mask: str) -> str:
        """The bits up to and including the first thrown one."""
        lowest = f"(({mask} & {self.thrown}) & -({mask} & {self.thrown}))"
        return f"(case when ({mask} & {self.thrown}) <> 0L then {mask} & ({lowest} * 2L - 1L) else {mask} end)"

    def errors(self, mask: str) -> str:
        by_cond: dict[str, int] = {}
        for i, r in enumerate(self.rules):
            if r.severity not in ("E", "W"):
                by_cond[r.severity] = by_cond.get(r.severity, 0) | 1 << i
        sometimes = [f"(case when {c} then {b}L else 0L end)" for c, b in by_cond.items()]
        return f"({mask} & ({' | '.join([self.bits(lambda r: r.severity == 'E'), *sometimes])}))"

    def words(self, mask: str) -> str:
        """The values for the texts of the fired rules, one list per rule with values; null when none of these fired."""
        if not self.valued:
            return f"cast(null as {WORDS})"
        lists = ", ".join(f"case when ({mask} & {1 << i}L) <> 0L then array({', '.join(h.blank(v) for v in self.rules[i].values)}) end" for i in self.valued)
        return f"case when ({mask} & {self.bits(lambda r: r.values)}) <> 0L then array({lists}) end"

    def entry(self, mask: str, stage: str = "0", order_no: str = "0", block: int = 0, obx_no: str = "0", at: str = "1", words: str | None = None) -> str:
        """The entry of ``mask``, a column of the row."""
        return (f"named_struct('stage', {stage}, 'order_no', {order_no}, 'block', {block}, 'obx_no', {obx_no}, 'grp', {self.number}, "
                f"'at', {at}, 'mask', {mask}, 'errors', {self.errors(mask)}, 'words', {words or self.words(mask)})")

    def entries(self, mask: str, **place) -> str:
        """A list with the entry, empty when no rule fired."""
        return f"case when {mask} <> 0L then cast(array({self.entry(mask, **place)}) as array<{ENTRY}>) else {NO_ENTRY} end"

    def table(self) -> str:
        def row(i: int, r: Rule) -> str:
            slot = self.valued.index(i) if r.values else -1
            repeat = "cast(null as int)" if r.repeat is None else str(r.repeat)
            pieces = ", ".join(h.quote(p) for p in r.text.split("{}"))
            return (f"named_struct('bit', {1 << i}L, 'pos', {i}, 'rule', '{r.rule}', 'thrown', {str(r.thrown).lower()}, 'segment', '{r.segment}', "
                    f"'field', {r.field}, 'repeat', {repeat}, 'slot', {slot}, 'pieces', array({pieces}))")

        return f"array({', '.join(row(i, r) for i, r in enumerate(self.rules))})"


def spelled(entries: str, groups: list[Group]) -> str:
    """The findings of a list of entries; ``groups`` in the order of their numbers, from 1."""
    text = ("case when r.slot < 0 then r.pieces[0] else array_join(flatten(zip_with(r.pieces, e.words[r.slot], "
            "(piece, word) -> array(piece, coalesce(word, '')))), '') end")
    one = ("named_struct('stage', e.stage, 'order_no', e.order_no, 'block', e.block, 'obx_no', e.obx_no, 'pos', r.pos, 'rule', r.rule, "
           "'severity', case when (e.errors & r.bit) <> 0L then 'E' else 'W' end, 'thrown', r.thrown, 'segment', r.segment, "
           f"'seg_repeat', coalesce(r.repeat, e.at), 'field', r.field, 'text', {text})")
    table = f"array({', '.join(g.table() for g in groups)})"
    return f"flatten(transform({entries}, e -> transform(filter({table}[e.grp - 1], r -> (e.mask & r.bit) <> 0L), r -> {one})))"


def count(entries: str, bits: str) -> str:
    """Number of set bits of a mask expression over the entries, written with ``e``."""
    return f"aggregate({entries}, 0, (n, e) -> n + bit_count({bits}))"
