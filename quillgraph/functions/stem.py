"""An English suffix stemmer, in two forms: one SQL expression (for Spark and for DuckDB) and an Arrow step.

The Arrow step is what the index uses: a vocabulary is far smaller than its texts, and the nested SQL expression costs
more to plan than a vocabulary to stem.  The SQL form checks it and serves where Python is not wanted.

Words are mapped to a string of C and V (consonant, vowel).  The measure of a word is the number of VC in it, so every
condition of the classical five steps becomes a test on that string.  ``let`` binds a step's result once, which keeps
the expression linear in size.  It is meant for a distinct vocabulary: stem each word once and join back.

Settled cases: a leading y is a vowel; the first suffix of a step's list that matches decides, whether or not its
condition holds; any doubled final consonant is undoubled at the end; words of at most two letters stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The suffix lists of the steps, in the order in which they are tried.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_FROM = "bcdfghjklmnpqrstvwxz0123456789_" + "aeiou"
_TO = "C" * 31 + "V" * 5


class _Sql:
    """Builds the expression for one engine."""

    def __init__(self, duckdb: bool):
        self.duckdb = duckdb
        self.names = 0

    def let(self, value: str, body: Callable[[str], str]) -> str:
        self.names += 1
        x = f"x{self.names}"
        if self.duckdb:
            return f"list_transform([{value}], lambda {x}: {body(x)})[1]"
        return f"transform(array({value}), {x} -> {body(x)})[0]"

    def signs(self, w: str) -> str:
        """The C and V string of a word; y is a vowel at the start and after a consonant."""
        s = f"replace('^' || translate({w}, '{_FROM}', '{_TO}'), '^y', '^V')"
        for _ in range(4):
            s = f"replace(replace({s}, 'Cy', 'CV'), 'Vy', 'VC')"
        return f"replace({s}, '^', '')"

    def measure(self, w: str) -> str:
        return self.let(self.signs(w), lambda s: f"((length({s}) - length(replace({s}, 'VC', ''))) / 2)")

    def vowel(self, w: str) -> str:
        return f"({self.signs(w)} LIKE '%V%')"

    def cut(self, w: str, n: int) -> str:
        return f"left({w}, greatest(length({w}) - {n}, 0))"

    def doubled(self, w: str) -> str:
        return f"(length({w}) >= 2 AND right({w}, 1) = left(right({w}, 2), 1) AND {self.signs(w)} LIKE '%C')"

    def cvc(self, w: str) -> str:
        return f"({self.signs(w)} LIKE '%CVC' AND right({w}, 1) NOT IN ('w', 'x', 'y'))"

    def plural(self, w: str) -> str:
        return f"CASE WHEN {w} LIKE '%sses' OR {w} LIKE '%ies' THEN {self.cut(w, 2)} WHEN {w} LIKE '%ss' THEN {w} WHEN {w} LIKE '%s' THEN {self.cut(w, 1)} ELSE {w} END"

    def past(self, w: str) -> str:
        def mend(b: str) -> str:
            short = f"{self.measure(b)} = 1 AND {self.cvc(b)}"
            return (
                f"CASE WHEN {b} LIKE '%at' OR {b} LIKE '%bl' OR {b} LIKE '%iz' THEN {b} || 'e' "
                f"WHEN {self.doubled(b)} AND right({b}, 1) NOT IN ('l', 's', 'z') THEN {self.cut(b, 1)} WHEN {short} THEN {b} || 'e' ELSE {b} END"
            )

        return (
            f"CASE WHEN {w} LIKE '%eed' THEN CASE WHEN {self.measure(self.cut(w, 3))} > 0 THEN {self.cut(w, 1)} ELSE {w} END "
            f"WHEN {w} LIKE '%ed' AND {self.vowel(self.cut(w, 2))} THEN {self.let(self.cut(w, 2), mend)} "
            f"WHEN {w} LIKE '%ing' AND {self.vowel(self.cut(w, 3))} THEN {self.let(self.cut(w, 3), mend)} ELSE {w} END"
        )

    def y(self, w: str) -> str:
        return f"CASE WHEN {w} LIKE '%y' AND {self.vowel(self.cut(w, 1))} THEN {self.cut(w, 1)} || 'i' ELSE {w} END"

    def longest(self, w: str, suffixes: list[str], body: Callable[[str, str], str]) -> str:
        """``body`` of the first suffix in the list that ``w`` ends with and of what stands before it; ``w`` if none does."""
        found = "CASE " + " ".join(f"WHEN {w} LIKE '%{s}' THEN '{s}'" for s in suffixes) + " ELSE '' END"
        return self.let(found, lambda s: f"CASE WHEN {s} = '' THEN {w} ELSE {self.let(f'left({w}, length({w}) - length({s}))', lambda b: body(s, b))} END")

    def replaced(self, w: str, pairs: list[tuple[str, str]]) -> str:
        new = lambda s: f"CASE {s} " + " ".join(f"WHEN '{a}' THEN '{r}'" for a, r in pairs) + " ELSE '' END"
        return self.longest(w, [a for a, _ in pairs], lambda s, b: f"CASE WHEN {self.measure(b)} > 0 THEN {b} || {new(s)} ELSE {w} END")

    def dropped(self, w: str) -> str:
        return self.longest(w, STEP4, lambda s, b: f"CASE WHEN {self.measure(b)} > 1 AND ({s} <> 'ion' OR right({b}, 1) IN ('s', 't')) THEN {b} ELSE {w} END")

    def final_e(self, w: str) -> str:
        b = self.cut(w, 1)
        return f"CASE WHEN {w} LIKE '%e' AND ({self.measure(b)} > 1 OR ({self.measure(b)} = 1 AND NOT {self.cvc(b)})) THEN {b} ELSE {w} END"

    def undoubled(self, w: str) -> str:
        return f"CASE WHEN {self.doubled(w)} AND {self.measure(w)} > 1 THEN {self.cut(w, 1)} ELSE {w} END"

    def stem(self, word: str) -> str:
        steps = [self.plural, self.past, self.y, lambda w: self.replaced(w, STEP2), lambda w: self.replaced(w, STEP3), self.dropped, self.final_e, self.undoubled]

        def chain(w: str, rest: list[Callable[[str], str]]) -> str:
            return self.let(rest[0](w), lambda x: chain(x, rest[1:])) if rest else w

        return f"CASE WHEN length({word}) <= 2 THEN {word} ELSE {chain(word, steps)} END"


def stem_sql(word: str, duckdb: bool = False) -> str:
    """The SQL expression of the stem of a lower-case word column."""
    return _Sql(duckdb).stem(word)


_SIGNS = str.maketrans(_FROM, _TO)


class _Values:
    """The steps on values; the same conditions as the expression."""

    @staticmethod
    def signs(w: str) -> str:
        out = []
        for c in w.translate(_SIGNS):
            out.append(("C" if out and out[-1] == "V" else "V") if c == "y" else c)
        return "".join(out)

    def measure(self, w: str) -> int:
        return self.signs(w).count("VC")

    def doubled(self, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and self.signs(w)[-1] == "C"

    def cvc(self, w: str) -> bool:
        return self.signs(w)[-3:] == "CVC" and w[-1] not in "wxy"

    def mended(self, b: str) -> str:
        if b.endswith(("at", "bl", "iz")):
            return b + "e"
        if self.doubled(b) and b[-1] not in "lsz":
            return b[:-1]
        return b + "e" if self.measure(b) == 1 and self.cvc(b) else b

    def inflection(self, w: str) -> str:
        if w.endswith(("sses", "ies")):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if self.measure(w[:-3]) else w
        else:
            for end in ("ed", "ing"):
                if w.endswith(end):
                    b = w[: -len(end)]
                    w = self.mended(b) if "V" in self.signs(b) else w
                    break
        return w[:-1] + "i" if w.endswith("y") and "V" in self.signs(w[:-1]) else w

    def stem(self, word: str) -> str:
        if len(word) <= 2:
            return word
        w = self.inflection(word)
        for pairs, least in ((STEP2, 1), (STEP3, 1), ([(x, "") for x in STEP4], 2)):
            end, new = next(((a, b) for a, b in pairs if w.endswith(a)), ("", ""))
            b = w[: len(w) - len(end)]
            if end and self.measure(b) >= least and (end != "ion" or least == 1 or b[-1:] in ("s", "t")):
                w = b + new
        if w.endswith("e"):
            m = self.measure(w[:-1])
            w = w[:-1] if m > 1 or (m == 1 and not self.cvc(w[:-1])) else w
        return w[:-1] if self.doubled(w) and self.measure(w) > 1 else w


stem = _Values().stem


def with_stems(words: DataFrame, word: str, name: str) -> DataFrame:
    """(word, name): each row's word with its stem, in Arrow batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[0], pa.array([None if w is None else stem(w) for w in b[0].to_pylist()], pa.string())], [word, name])

    return words.select(word).mapInArrow(work, f"`{word}` string, `{name}` string")
