"""Personal information in free text: weak supervision over candidate spans.

Each text yields candidate spans of five kinds (email, phone, id_number, address, name).  Labelers vote for or against a
candidate or abstain: format rules (regex), gazetteers (known people's names, street words, label words) and context
(what stands before and after).  The votes of all candidates of all texts are counted by pattern; expectation
maximisation over these counts estimates each labeler's reliability and the share of true candidates, kind by kind,
without labelled data.  The resulting probabilities are the soft labels of a bounded sample on which the final span
classifier (logistic regression on the votes, the shape and the words around) is trained.  The classifier decides every
candidate; overlapping mentions of a text are settled by probability, then length.

Every pattern reads the whole text, whatever its length.  The counts cover all texts.  The classifier is fitted on about
SAMPLE candidates of each kind, drawn by the hash of what they are and where they stand.  Known names are tested by hash
sets: those of up to MAX_PEOPLE people are broadcast, a larger table is joined to the words that a text looks up
(``looked_up``).  Either way a text meets the same names, and the results are the same.

Defined results: null and empty texts have no mentions; positions are code points from 0, end exclusive; a repeated row
gives its mentions again; a null id stays null.  ``redacted`` finds and replaces within the row, so null and repeated ids
and different texts under one id are each replaced at their own places.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import materialize

KINDS = ("email", "phone", "id_number", "address", "name")
SAMPLE, MAX_PEOPLE, BUCKETS, LABELERS = 8_000, 100_000, 4096, 5
#: Letters of the longest name that is looked for inside a longer word of a mail address.
LONGEST = 24

# --- fixed values: words that the labelers know -------------------------------------------------------------------
STREET = "street st road rd lane ln avenue ave drive dr court ct boulevard blvd place pl square sq way terrace crescent close row parkway highway hwy".split()
STREET_FOREIGN = "straße strasse str weg allee platz gasse ring damm ufer".split()
STREET_BEFORE = "rue avenue boulevard place chemin impasse allée quai calle avenida plaza paseo carrera via viale piazza rua".split()
UNIT = r"(?:flat|apt|apartment|suite|unit|room|floor|app\.?|appt|piso|wohnung|whg)"
ID_LABEL = (
    r"(?:SSN|SIN|social (?:security|insurance)(?: (?:number|no\.?|nr\.?))?|tax(?:payer)? (?:id|number|no\.?)|national (?:id|identity)(?: (?:number|card|no\.?))?|"
    r"NI(?:NO)?(?: (?:number|no\.?))?|national insurance(?: (?:number|no\.?))?|passport(?: (?:number|no\.?))?|identity (?:number|card|no\.?)|id (?:number|card|no\.?)|"
    r"personalausweis(?:nummer|-?nr\.?)?|ausweis(?:nummer|-?nr\.?)?|reisepass(?:nummer|-?nr\.?)?|steuer-?id(?:entifikationsnummer)?|sozialversicherungsnummer|"
    r"dni|nie|nif|curp|rfc|cpf|insee|nir|num[ée]ro de s[ée]cu(?:rit[ée] sociale)?|driver'?s? licen[cs]e(?: (?:number|no\.?))?)"
)
#: The words of NAMED, which a run of capitalised words may begin with.
CUES = set("author reviewer owner assignee maintainer by and ask user contact an für cc dear hi hello from with client customer patient name thanks to todo fixme".split())
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "mme", "mlle", "sr", "sra", "sir"}
DOMAINS = set("com org net edu gov io dev de fr es uk eu us ca at ch it nl info biz example invalid test local".split())
CALLED = re.compile(r"(?i)(?:call|phone|tel(?:efon|ephone)?|mobile|cell|fax|reach (?:them|me|us|him|her) (?:on|at)|on call|dial|ring|handy|whatsapp|sms)\W{0,6}$")
WRITTEN = re.compile(r"(?i)(?:contact|mail|e-?mail|cc|bcc|to|from|write|by|send)\W{0,5}$|<$")
NAMED = re.compile(
    r"(?i)(?:\b(?:author|reviewer|owner|assignee|maintainer|by|thanks to|and|ask|user|contact|todo\s*\(|fixme\s*\(|an|für|cc|dear|hi|hello|from|with|reported by|signed-off-by|co-authored-by|approved by|contributed by|client|customer|patient|name)"
    r"[\s:=\"'(<]{1,4}|\(\s*\d+\s*,\s*['\"]|;\s+)(?:(?:mr|mrs|ms|miss|dr|prof|herr|frau|mme)\.?\s+)?$"
)
ACTS = re.compile(
    r"(?i)^\W{0,3}(?:will|would|can|could|did|said|says|asked|asks|wrote|writes|reported|reports|fixed|fixes|added|adds|"
    r"changed|changes|reviewed|reviews|merged|approved|signed|called|mailed|sent|moved|lives|works|joined|left|<|\(|,\s*\d|,\s*(?:flat|apt)|\)?:|['\"])"
)
MEASURED = re.compile(r"(?i)^\W{0,2}(?:ms|us|ns|s|sec|seconds?|min|minutes?|hours?|days?|kb|mb|gb|tb|px|em|pt|rows?|bytes?|items?|lines?|times|percent|of \d{4}-)\b|^\s*%")
COUNTED = re.compile(r"(?i)(?:\b(?:build|range|part|row|version|v|digest|sha|issue|line|rev|commit|port|id)\W{0,2}|[A-Z]{2,}-|[\w.-])$")
#: What a place is followed by if the text goes on: a preposition, a conjunction or an auxiliary.
GOES_ON = re.compile(r"(?i)^ (?:about|after|and|at|before|between|by|during|ext|for|from|if|in|is|on|or|to|until|was|when|while|with|x\d|\()")

# --- candidate spans ----------------------------------------------------------------------------------------------
_AT = r"(?:@|\s?[\[({<]\s?(?:at|arroba)\s?[\])}>]\s?|\s(?:at|AT|arroba)\s(?=[\w-]+(?:\s(?:dot|DOT|punkt)\s|\s?[\[({]\s?(?:dot|punkt))))"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|punkt|punto)\s?[\])}>]\s?|\s(?:dot|DOT|punkt)\s)"
# Runs are taken whole (possessively): what follows a run begins with no sign of a run, so giving signs back finds nothing.
_EMAIL = re.compile(rf"(?<![\w.+%-])[\w%+-]++(?:{_DOT}[\w%+-]++)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w-])", re.I)
_PHONE = re.compile(
    r"(?<![\w.+/-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ ./-]\d{2,5}){1,4}|\+\d{8,15}|\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]\d{2,5}){1,3}|0\d{2,4}[ /]\d{3,8}(?:[ -]\d{2,5}){0,2}|(?:1(?=[-. ]\d{3}([-. ])\d{3}\1\d{4})[-. ])?\d{3}([-. ])\d{3}\2\d{4}|(?<!\d )0[1-9]([ .-])\d{2}(?:\3\d{2}){3}(?! \d))(?![\w]|[-./]\d)"
)
_ID = re.compile(
    rf"(?<!\w)(?=[AaCcDdIiNnPpRrSsTtſıİ])(?P<label>(?i:{ID_LABEL}))(?!\w)\s*[:#=]?\s*(?P<l>(?=[A-Z0-9 .-]*\d[A-Z0-9 .-]*\d)[A-Z0-9](?:[ .-]?[A-Z0-9]){{4,17}})(?![\w])"
    r"|(?<![\w.+-])(?P<f>\d{3}[- ]\d{2}[- ]\d{4}|\d{6}-\d{5}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]?\d{7,8}-?[A-Z])(?![\w-]|\.\d)"
)
# A capital of any script.  Those beyond the basic plane stand apart, as a class with both kinds is searched slowly.
_CAPITALS = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Lu", "Lt")]
_UPPER = f"(?:[{''.join(c for c in _CAPITALS if c <= chr(0xFFFF))}]|(?=[{chr(0x10000)}-{chr(sys.maxunicode)}])[{''.join(c for c in _CAPITALS if c > chr(0xFFFF))}])"
_W = rf"{_UPPER}\w*(?:[’'-]\w+)*"
_HOUSE = r"\d{1,5}(?:[ -]?(?:bis|ter|[A-Za-z]))?(?!\w)"
_TOWN = rf"{_W}(?:[ -]{_W}){{0,3}}"
_POST = r"(?:[A-Z]{2},? \d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|\d{4,5})(?!\w)"
_END = rf"(?:,? {_TOWN},? {_POST}|,? \d{{4,5}} {_TOWN}|, {_TOWN})?"
_ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?i:{UNIT}) \d{{1,4}}[A-Za-z]?, )?(?:"
    rf"{_HOUSE},? (?:{_W} ){{1,4}}?(?i:{'|'.join(STREET)})\b\.?"
    rf"|{_HOUSE},? (?i:{'|'.join(STREET_BEFORE)}) (?:(?i:de|des|du|de la|del|la|las|los|di) )?{_W}(?:[ -]{_W}){{0,3}}"
    rf"|(?:{_W} )?{_W}(?: (?i:{'|'.join(STREET_FOREIGN)})\b\.?|(?i:(?<=str)\.|(?<=straße)|(?<=strasse)|(?<=weg))) {_HOUSE}"
    rf")(?:, (?i:{UNIT}) \d{{1,4}}[A-Za-z]?)?{_END}"
)
_NUMBERED = re.compile(r"\d")
_TOKEN = rf"(?:{_UPPER}\w*(?:[’'-]\w+)+|{_UPPER}\w+|{_UPPER}\.)"
_RUN = re.compile(rf"(?<![\w@.-])(?<!\w[’']){_TOKEN}(?:,? {_TOKEN})+(?![\w@])")
_WORDS = re.compile(r"[^\W\d_]\w*(?:[’'-]\w+)*\.?")
_ANY_CASE = re.compile(r"[^\W\d_][\w’'-]*")


# What every mail address holds: a text without it is not searched for one.
_AT_SIGN = re.compile(r"@|[\[({<]\s?(?i:at|arroba)\s?[\])}>]|\s(?i:at|arroba)\s")


class _Taken:
    """Disjoint spans in order, as they are found by one pattern after the other."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, s: int, e: int) -> None:
        if not self.meets(s, e):
            i = bisect_left(self.starts, s)
            self.starts.insert(i, s)
            self.ends.insert(i, e)

    def meets(self, s: int, e: int) -> bool:
        i = bisect_right(self.ends, s)
        return i < len(self.starts) and self.starts[i] < e


def _near(text: str, s: int, e: int) -> tuple[str, str]:
    """What stands before and after on the same line."""
    before = text[max(0, s - 48) : s].rpartition("\n")[2].rpartition("\r")[2]
    after = text[e : e + 32].partition("\n")[0].partition("\r")[0]
    return before, after


def _names(text: str, given: set[str], family: set[str], taken: _Taken) -> Iterator[tuple[int, int]]:
    """Candidate names: short runs of capitalised words, and inside longer runs pairs known to the gazetteer or with a cue before them."""
    for m in _RUN.finditer(text):
        parts = [(p.start() + m.start(), p.end() + m.start(), p.group()) for p in _WORDS.finditer(m.group())]
        while parts and ((w := parts[0][2].rstrip(".").lower()) in TITLES or (w in CUES and w not in given and w not in family)):
            parts = parts[1:]
        parts = [p for p in parts if not taken.meets(p[0], p[1])]
        i = 0
        while i < len(parts) - 1:
            best = None
            for j in (i + 2, i + 1):
                if j >= len(parts) or (j == i + 2 and not re.fullmatch(r"\w\.", parts[i + 1][2]) and not re.fullmatch(r"\w\.", parts[j][2])):
                    continue
                span = text[parts[i][0] : parts[j][1]]
                if "\n" in span or span.count(",") > 1 or "_" in span or any(map(str.isdigit, span)):
                    continue
                ends = [parts[i][2].lower(), parts[j][2].lower()]
                hits = sum(w in given or w in family for w in ends)
                initial = sum(len(w) == 2 and w.endswith(".") for w in ends)
                cued = len(parts) > j - i + 1 and initial < 2 and not CUES.intersection(ends) and bool(NAMED.search(_near(text, parts[i][0], parts[j][1])[0]))
                if cued or hits == 2 or (hits == 1 and (initial or len(parts) == j - i + 1)) or (len(parts) == j - i + 1 and initial < 2):
                    best = j
                    break
            if best is None:
                i += 1
            else:
                end = parts[best][1]
                yield parts[i][0], end
                i = best + 1


def _lower_names(text: str, given: set[str], family: set[str]) -> Iterator[tuple[int, int]]:
    """Pairs of known names in any case, for texts whose capitals are lost."""
    w = [(m.start(), m.end(), m.group().lower()) for m in _ANY_CASE.finditer(text)]
    for (s, m, a), (n, e, b) in zip(w, w[1:], strict=False):
        if ((a in given and b in family) or (a in family and b in given)) and text[m:n] in (" ", ", "):
            yield s, e


def _vote(yes: bool, no: bool = False) -> int:
    return 1 if yes and not no else 2 if no else 0


def _held(mail: str) -> Iterator[str]:
    """The words of a mail address and what they hold, of four letters or more."""
    for w in re.findall(r"[^\W\d_]{4,}", mail.lower()):
        yield w
        for n in range(4, min(len(w), LONGEST) + 1):
            for i in range(len(w) - n + 1):
                yield w[i : i + n]


def _named_in(mail: str, given: set[str], family: set[str]) -> bool:
    """Whether a word of a mail address is or holds a known name of four letters or more."""
    return any(w in given or w in family for w in _held(mail))


def looked_up(text: str) -> Iterator[str]:
    """All that ``candidates_of`` may look up among the known names in a text, whichever names are known."""
    if _AT_SIGN.search(text):
        for m in _EMAIL.finditer(text):
            yield from _held(m.group())
    for m in _RUN.finditer(text):
        for w in _WORDS.findall(m.group()):
            yield w.lower()
            yield w.rstrip(".").lower()
    if text.islower():
        for m in _ANY_CASE.finditer(text):
            yield m.group().lower()


def candidates_of(text: str, given: set[str], family: set[str]) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes) of every candidate of a text; a vote is 0 (abstains), 1 (for) or 2 (against)."""
    out: list[tuple[int, int, int, tuple[int, ...]]] = []
    taken = _Taken()
    if _AT_SIGN.search(text):
        for m in _EMAIL.finditer(text):
            s, e = m.span()
            before, after = _near(text, s, e)
            top = re.split(r"[^A-Za-z]+", m.group())[-1].lower()
            taken.add(s, e)
            votes = (
                _vote(any(c in m.group() for c in "@[(")),
                _vote(top in DOMAINS, len(top) > 8),
                _vote(_named_in(m.group(), given, family)),
                _vote(bool(WRITTEN.search(before)), before.endswith("://") or m.group().startswith("git@")),
                _vote(after[:1] in ">;\",') " or not after, after[:1] in ":/="),
            )
            out.append((0, s, e, votes))
    if _NUMBERED.search(text):
        for m in _ADDRESS.finditer(text):
            s, e = m.span()
            before, after = _near(text, s, e)
            post = re.search(r"\d{4,5}|[A-Z]\d[A-Z\d]? ?\d[A-Z]{2}", m.group().split(",", 1)[-1]) is not None
            parted = "," in m.group()
            closed = after[:1] in ",'\")." or not after or bool(GOES_ON.match(after))
            taken.add(s, e)
            votes = (
                _vote(parted and post, not parted),
                _vote(bool(re.search(rf"(?i){UNIT}|\b(?:straße|str\.|weg|rue|road|rd|drive|avenue|ave|street|st\.|court|blvd)", m.group()))),
                _vote(parted),
                _vote(bool(re.search(r"(?i)(?:to|at|in|an|lives|address|anschrift|[,:'\"]) ?$", before))),
                _vote(closed, bool(MEASURED.match(after)) or (not closed and re.match(r" [a-z]{3,}", after) is not None)),
            )
            out.append((3, s, e, votes))
        for m in _ID.finditer(text):
            g = "l" if m.group("l") else "f"
            s, e = m.span(g)
            v = m.group(g)
            before, after = _near(text, s, e)
            digits = sum(c.isdigit() for c in v)
            # a label word as a variable or an attribute in code
            coded = g == "l" and (text[max(0, m.start() - 1) : m.start()] in tuple(".,;{(") or text[s - 1 : s] == "=") and m.group("label").islower()
            shaped = re.fullmatch(r"\d{3}[- ]?\d{2}[- ]?\d{4}|\d{6}-?\d{5}|[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]|[A-Za-z]?\d{7,8}-?[A-Za-z]", v) is not None
            loose = g == "f" and re.fullmatch(r"\d{3} \d{2} \d{4}", v) is not None  # three plain numbers in a row
            votes = (
                _vote(shaped and not loose, digits < 6 or loose),
                _vote(g == "l" and not coded, coded),
                _vote(digits >= 6 and " " * 2 not in v, digits < 6),
                _vote(bool(re.search(r"['\"(] ?$|: $|\b(?:no\.?|number|nr\.?) $", before)) or (g == "l" and not coded), coded or bool(COUNTED.search(before))),
                _vote(after[:1] in ".,;)'\"" or not after or bool(GOES_ON.match(after)), bool(MEASURED.match(after))),
            )
            out.append((2, s, e, votes))
            taken.add(s, e)
        for m in _PHONE.finditer(text):
            s, e = m.span()
            v = m.group()
            before, after = _near(text, s, e)
            digits = sum(c.isdigit() for c in v)
            grouped = re.fullmatch(r"(?:1[-. ])?\d{3}([-.])\d{3}\1\d{4}|1 \d{3} \d{3} \d{4}|0\d([ .-])\d{2}(?:\2\d{2}){3}|0\d{2} \d{4} \d{4}|0\d+/\d+-\d+", v) is not None
            closed = after[:1] in ".,;)'\"" or not after or bool(GOES_ON.match(after))
            votes = (
                _vote(9 <= digits <= 15, digits < 8 or digits > 15),
                _vote(v[0] in "+(" or grouped, v[0] not in "+(0" and not grouped and not CALLED.search(before)),
                _vote(bool(CALLED.search(before)) or bool(re.search(r"(?i)\"phone\": ?\"$", before))),
                _vote(bool(re.search(r"['\"(]$|: $|(?:on|at) $", before)), bool(COUNTED.search(before))),
                _vote(closed, bool(MEASURED.match(after)) or (not closed and re.match(r" [^\W\d_]{3,}", after) is not None)),
            )
            out.append((1, s, e, votes))
            taken.add(s, e)
    spans = dict.fromkeys(_names(text, given, family, taken))
    if text.islower():
        spans |= dict.fromkeys(_lower_names(text, given, family))
    for s, e in spans:
        w = [x.rstrip(".").lower() for x in re.findall(r"[^\W\d_][\w’'-]*\.?", text[s:e])]
        full = [x for x in w if len(x) > 1]
        before, after = _near(text, s, e)
        both = any(x in given for x in full) + any(x in family for x in full)
        initial = any(len(x) == 1 for x in w)
        start = not before.strip(" \t/#*->.")
        heading = start and not after.strip(" #=*.:")
        cue, act = bool(NAMED.search(before)), bool(ACTS.match(after))
        framed = cue and (act or after[:1] in ",:;<(\"')>" or not after.strip())
        votes = (
            _vote(any(x in family for x in full), both == 0),
            _vote(any(x in given for x in full) or (initial and both > 0)),
            _vote(cue or (start and act), both == 0 and heading),
            _vote(act, both < 2 and heading),
            _vote(framed, both < 2 and bool(re.match(rf"\s{_UPPER}", after))),
        )
        out.append((4, s, e, votes))
    return out


def _features(text: str, kind: int, s: int, e: int, votes: tuple[int, ...]) -> list[int]:
    """Hashed features of a candidate: its votes, its shape, the words and signs around it."""
    before, after = _near(text, s, e)
    v = text[s:e]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "9", re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a", v)))[:24]
    prev = re.findall(r"[^\W\d_]+|[^\w\s]", before.lower())[-2:]
    nxt = re.findall(r"[^\W\d_]+|[^\w\s]", after.lower())[:2]
    raw = [f"{i}={x}" for i, x in enumerate(votes)] + [f"sh={shape}", f"n={min(len(v), 80) // 4}"] + [f"p{len(prev) - i}={x}" for i, x in enumerate(prev)] + [f"q{i}={x}" for i, x in enumerate(nxt)]
    return [zlib.crc32(f"{kind}|{x}".encode()) % BUCKETS for x in raw]


#: Pseudo-counts of each labeler's votes (abstains, for, against) for false and for true candidates; the same fixed few for all labelers, kinds and sizes.
PRIOR = np.array([(8.0, 2.4, 9.6), (7.4, 12.0, 0.6)])
#: A vote for is at least this many times as likely for a true candidate as for a false one, and a vote against the reverse.
BETTER = 2.0


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """(share of true ones, P(vote | truth) per labeler, P(true | pattern)) by expectation maximisation over vote counts.

    Starts from each pattern's surplus of votes for over votes against; labelers are independent given the truth.  The
    counts decide: the prior weighs as much as twenty candidates.  What keeps a kind that is nearly all true (or false)
    from being split in two is that each labeler must be better than chance by the factor BETTER; the estimate that
    breaks this is cut back, the rest counting as abstention.
    """
    if not patterns:
        return 0.5, np.full((2, LABELERS, 3), 1 / 3), {}
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    p = 1 / (1 + np.exp(-1.5 * ((v == 1).sum(1) - 2.0 * (v == 2).sum(1) - 1)))
    at, votes = np.arange(v.shape[1]), (v[:, :, None] == np.arange(3)).astype(float)
    theta = np.full((2, v.shape[1], 3), 1 / 3)
    share = 0.5
    for _ in range(rounds):
        share = float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98))
        for t, w in ((0, n * (1 - p)), (1, n * p)):
            theta[t] = ((w[:, None, None] * votes).sum(0) + PRIOR[t]) / (w.sum() + PRIOR[t].sum())
        for worse, better, vote in ((0, 1, 1), (1, 0, 2)):
            over = np.maximum(theta[worse, :, vote] - theta[better, :, vote] / BETTER, 0)
            theta[worse, :, vote] -= over
            theta[worse, :, 0] += over
        l1 = math.log(share) + np.log(theta[1][at, v]).sum(1)
        l0 = math.log(1 - share) + np.log(theta[0][at, v]).sum(1)
        p = 1 / (1 + np.exp(np.clip(l0 - l1, -40, 40)))
    return share, theta, {tuple(map(int, a)): float(b) for a, b in zip(v, p, strict=True)}


def train(rows: list[tuple[list[int], float]], rounds: int = 250, rate: float = 0.4, decay: float = 1e-4) -> np.ndarray:
    """Weights (BUCKETS + 1) of a logistic regression with soft labels, by full-batch gradient steps with adaptive rates."""
    w = np.zeros(BUCKETS + 1)
    if not rows:
        return w
    y = np.array([p for _, p in rows])
    lens = np.array([len(f) for f, _ in rows])
    flat = np.concatenate([np.asarray(f, np.int64) for f, _ in rows])
    owner = np.repeat(np.arange(len(rows)), lens)
    seen = np.full(BUCKETS + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(owner, w[flat], len(rows)) + w[-1]
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        grad = np.append(np.bincount(flat, g[owner], BUCKETS), g.sum()) + decay * w / len(rows)
        seen += grad * grad
        w -= rate * grad / np.sqrt(seen)
    return w


def settle(found: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the mentions kept: the likelier, then the longer, then the earlier wins an overlap."""
    kept: list[tuple[int, int, int]] = []
    for _, s, e, k in sorted(found, key=lambda x: (-round(x[0], 3), x[1] - x[2], x[1])):
        i = bisect_left(kept, (s,))
        if (i == 0 or kept[i - 1][1] <= s) and (i == len(kept) or e <= kept[i][0]):
            insort(kept, (s, e, k))
    return [(k, s, e) for s, e, k in kept]


_CAND = "id {kind}, kind array<tinyint>, s array<int>, e array<int>, votes array<int>, feats array<binary>"
#: Rows of a batch of words that are looked up.
_LOOKED_UP = 1 << 16


class _Known:
    """The known names for a text: those broadcast, or those joined to the row."""

    def __init__(self, shared) -> None:  # noqa: ANN001
        self.shared = shared

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[set[str], set[str]]]:
        if self.shared is not None:
            while True:
                yield self.shared.value
        for g, f in zip(batch["_given"].to_pylist(), batch["_family"].to_pylist(), strict=True):
            yield set(g or ()), set(f or ())


def _prepared(df: DataFrame, id_col: str, text_col: str, people: DataFrame, given: str, family: str, most: int) -> tuple[DataFrame, _Known]:
    """The rows (id, text and, if the people are too many to broadcast, the names met in the text) and how to read the names.

    Both ways answer every look-up of a text alike: what is joined is each known name among all that the text may look up.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = people.select(F.lower(F.trim(given)).alias("g"), F.lower(F.trim(family)).alias("f"))
    if people.count() <= most:
        held = names.distinct().collect()
        return rows, _Known(df.sparkSession.sparkContext.broadcast(({r["g"] for r in held if r["g"]}, {r["f"] for r in held if r["f"]})))
    flat = names.select(F.explode(F.array(F.struct(F.col("g").alias("w"), F.lit(True).alias("own")), F.struct(F.col("f").alias("w"), F.lit(False).alias("own")))).alias("x"))
    flat = flat.select("x.*").where(F.col("w") != "").groupBy("w").agg(F.max("own").alias("g"), F.max(~F.col("own")).alias("f"))
    keyed = rows.withColumn("_h", F.xxhash64("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.int64()), pa.array([w for _, w in held], pa.string())], ["_h", "w"])

        held: dict[tuple[int, str], None] = {}
        for b in batches:
            for h, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                for w in looked_up(text) if text else ():
                    held[h, w] = None
                    if len(held) >= _LOOKED_UP:
                        yield made()
                        held.clear()
        yield made()

    words = keyed.select("_h", "text").mapInArrow(work, "_h long, w string")
    met = words.join(flat, "w").groupBy("_h").agg(F.collect_set(F.when(F.col("g"), F.col("w"))).alias("_given"), F.collect_set(F.when(F.col("f"), F.col("w"))).alias("_family"))
    return keyed.join(met, "_h", "left").select("id", "text", "_given", "_family"), _Known(None)


def _scan(rows: DataFrame, known: _Known) -> DataFrame:
    """A row for each text with candidates; votes are numbered in base 3."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cols = [], ([], [], [], [], [])
            for i, (text, (g, f)) in enumerate(zip(b[1].to_pylist(), known.of(b), strict=False)):
                c = candidates_of(text, g, f) if text else []
                if c:
                    at.append(i)
                    cols[0].append([x[0] for x in c])
                    cols[1].append([x[1] for x in c])
                    cols[2].append([x[2] for x in c])
                    cols[3].append([sum(v * 3**q for q, v in enumerate(x[3])) for x in c])
                    cols[4].append([np.array(_features(text, *x), np.int16).tobytes() for x in c])
            kinds = [pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([b[0].take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "kind", "s", "e", "votes", "feats"])

    return rows.mapInArrow(work, _CAND.format(kind=dict(rows.dtypes)["id"]))


def fitted(cand: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights, a row a kind, from the candidates of all texts."""
    flat = cand.select("id", F.explode(F.arrays_zip("kind", "s", "votes", "feats")).alias("c")).select("id", "c.*")
    counts = flat.groupBy("kind", "votes").count().collect()  # at most kinds x 3 ** labelers rows
    truth: dict[int, dict[tuple[int, ...], float]] = {}
    total: dict[int, int] = {}
    for k in range(len(KINDS)):
        rows = [(_unpacked(r["votes"]), r["count"]) for r in counts if r["kind"] == k]
        total[k] = sum(c for _, c in rows)
        truth[k] = reliabilities(rows)[2]
    weights = np.zeros((len(KINDS), BUCKETS + 1))
    bounded = None
    for k, n in total.items():
        if n:
            drawn_by = F.xxhash64("id", "s", "votes", "feats")
            share = F.pmod(drawn_by, F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, sample / n))
            part = flat.where((F.col("kind") == k) & share).orderBy(drawn_by, "votes", "feats").limit(2 * sample).select("kind", "votes", "feats")
            bounded = part if bounded is None else bounded.unionByName(part)
    # in an order of their own: which rows are drawn and how their sums round do not depend on how the texts are spread
    drawn = sorted(bounded.collect(), key=lambda r: (r["votes"], bytes(r["feats"]))) if bounded is not None else []
    for k in range(len(KINDS)):
        weights[k] = train([(np.frombuffer(r["feats"], np.int16).tolist(), truth[k][_unpacked(r["votes"])]) for r in drawn if r["kind"] == k])
    return weights


def _unpacked(votes: int) -> tuple[int, ...]:
    return tuple(votes // 3**q % 3 for q in range(LABELERS))


def _decided(w: np.ndarray, spans: Iterator[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
    """The mentions among the candidates (kind, start, end, features) of one text."""
    found = []
    for k, s, e, f in spans:
        z = w[k][f].sum() + w[k][-1]
        if z > 0:
            found.append((1 / (1 + math.exp(-min(z, 30))), s, e, k))
    return settle(found)


def mentions(df: DataFrame, id_col: str, text_col: str, people: DataFrame, sample: int = SAMPLE, given: str = "given_name", family: str = "family_name", most: int = MAX_PEOPLE) -> DataFrame:
    """(id, spans array<struct<kind int, s int, e int>>): the mentions of each text that has any."""
    rows, known = _prepared(df, id_col, text_col, people, given, family, most)
    cand = materialize(_scan(rows, known), "p10-candidates")
    model = df.sparkSession.sparkContext.broadcast(fitted(cand, sample))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            at, spans = [], []
            for i, (ks, ss, es, fs) in enumerate(zip(*(b[c].to_pylist() for c in (1, 2, 3, 5)), strict=True)):
                kept = _decided(w, ((k, s, e, np.frombuffer(f, np.int16)) for k, s, e, f in zip(ks, ss, es, fs, strict=True)))
                if kept:
                    at.append(i)
                    spans.append([{"kind": k, "s": s, "e": e} for k, s, e in kept])
            kind_t = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b[0].take(pa.array(at, pa.int64())), pa.array(spans, kind_t)], ["id", "spans"])

    return cand.mapInArrow(decide, f"id {dict(rows.dtypes)['id']}, spans array<struct<kind:int,s:int,e:int>>").withColumnRenamed("id", id_col)


def listed(found: DataFrame, id_col: str) -> DataFrame:
    """(id, kind, start_pos, end_pos): one row a mention."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return found.select(id_col, F.explode("spans").alias("m")).select(
        id_col, F.element_at(names, F.col("m.kind") + 1).alias("kind"), F.col("m.s").cast("long").alias("start_pos"), F.col("m.e").cast("long").alias("end_pos")
    )


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with its mentions (kind, start, end), in order, replaced by [KIND]."""
    out, at = [], 0
    for k, s, e in spans:
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, id_col: str, text_col: str, people: DataFrame, sample: int = SAMPLE, given: str = "given_name", family: str = "family_name", most: int = MAX_PEOPLE) -> DataFrame:
    """(id, text): every row's text with its mentions replaced by [KIND]; all else, null and empty texts too, stays as it is.

    One map over the rows, once the classifier is fitted: nothing is joined by id and no text is shuffled.
    """
    rows, known = _prepared(df, id_col, text_col, people, given, family, most)
    model = df.sparkSession.sparkContext.broadcast(fitted(materialize(_scan(rows, known), "p10-candidates"), sample))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            out = []
            for text, (g, f) in zip(b[1].to_pylist(), known.of(b), strict=False):
                c = candidates_of(text, g, f) if text else []
                out.append(replaced(text, _decided(w, ((k, s, e, np.array(_features(text, k, s, e, v), np.int16)) for k, s, e, v in c))) if c else text)
            yield pa.RecordBatch.from_arrays([b[0], pa.array(out, pa.string())], ["id", "text"])

    made = rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, text string")
    return made.select(F.col("id").alias(id_col), F.col("text").alias(text_col))
