"""Personal data by a semi-Markov conditional random field over whole spans.

The base rules give exact spans. Around whatever holds a digit or an at sign (also a spelt one) an island of text is cut into
atoms: letter runs, digit runs and single marks. A segment is a run of at most LONGEST atoms with a type; the
weights see the whole span (digits, groups, checksum, parts, brackets, neighbours) and the types of adjacent segments.
Dynamic programming over bounded segments chooses boundaries and types jointly; its spans are added where they
overlap no base span. Training maximises the likelihood of segmentations of islands written by a rule from a fixed seed
(TRAINING of them), so that no corpus row is needed; the weights are a few hundred numbers.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections import deque
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LONGEST, TRAINING, EPOCHS = 17, 240, 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The same matches as without the look behind and the possessive runs, in linear time: a match begins where a run of digits does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_RUN = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(s: str) -> str:
    return "".join(_RUN.findall(s))


def _emails(text: str):
    """Leftmost non-overlapping: before each at sign the longest run of name characters after the last match."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base rules, by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# --- islands, atoms, features -------------------------------------------------------------------------------------

_HOLDS = re.compile(r"[0-9@]")
_MARK = re.compile(r"[\[(](?:at|dot)[\])]", re.I)
_AT = re.compile(r"[\[(]at[\])]", re.I)
_ANCHOR = re.compile(r"(?:[0-9@]|[\[(](?:at|dot)[\])])\S*", re.I)
_TOKEN = re.compile(r"\S+")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|\s|.", re.S)

FEATURES = ("bias", "strict_email", "spelt_email", "has_at", "letters", "mark_edge", "ip_form", "ip_range", "d9_12", "d13_19", "d_other", "luhn", "plus", "area", "phone_form", "seps", "glued", "word_edge", "two_dots", "hexlike", "account", "goes_on")
_STRICT = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_SPELT = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:[\[(]at[\])]|@) ?[A-Za-z0-9-]+(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]+)+", re.I)
#: What stands before a group of a bank account number.
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: [0-9A-Z]{4})* $")
_PHONE_FORM = re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}")


def islands(text: str):
    """(start, end) of runs of tokens with single blanks between them, in which two neighbours both hold a digit or at sign, or a spelt mark
    like [at] or (dot) stands at the blank. A run has a digit, an at sign or a spelt one."""
    start = end = 0  # of the run so far, of which the last token holds a digit or at sign (held), ends in a mark (open)
    use = held = open_ = False

    def marked(a, b):
        return any(b - k >= a and _MARK.fullmatch(text, b - k, b) for k in (4, 5))

    def absorb():
        """An open run goes on over the next token."""
        m = _TOKEN.match(text, end + 1) if open_ and text[end : end + 1] == " " else None
        return m.end() if m else end

    for m in _ANCHOR.finditer(text):
        a, b = m.span()
        while a > end and not text[a - 1].isspace():
            a -= 1
        holds, begins = bool(_HOLDS.search(text, a, b)), bool(_MARK.match(text, a, b))
        if open_ and a > end + 1 and (far := absorb()) > end:
            end, held, open_ = far, False, False
        if not (end and a == end + 1 and text[end] == " " and (begins or open_ or (held and holds))):
            if use:
                yield start, end
            start, use = a, False
            if begins and a > end + 1 and text[a - 1] == " ":
                start -= 1
                while start > end and not text[start - 1].isspace():
                    start -= 1
        end, held, open_ = b, holds, marked(a, b)
        use = use or holds or bool(_AT.search(text, a, b))
    if use:
        yield start, absorb()


def span_features(text: str, a: int, b: int) -> np.ndarray:
    s, d = text[a:b], _digits(text[a:b])
    before, after = text[a - 1 : a], text[b : b + 1]
    letters = any(c.isalpha() for c in s)
    ip_form = bool(_IP.fullmatch(s))
    phone = bool(_PHONE_FORM.fullmatch(s))
    spelt = bool(_SPELT.fullmatch(s))
    return np.array(
        [
            1,
            bool(_STRICT.fullmatch(s)),
            spelt,
            "@" in s,
            letters,
            not (s[-1].isalnum() and (s[0].isalnum() or s[0] in "+(")),
            ip_form,
            ip_form and all(map(_small, s.split("."))),
            9 <= len(d) <= 12,
            13 <= len(d) <= 19,
            not 9 <= len(d) <= 19,
            13 <= len(d) <= 19 and luhn(d) and not letters,
            s[0] == "+",
            "(" in s and ")" in s,
            phone,
            sum(c in " -." for c in s) >= 2,
            (before.isalnum() or after.isalnum()),
            before in ("+", "(", "@", ".", "-", "_", "%"),
            ".." in s,
            letters and bool(d) and "@" not in s and not spelt,
            before == " " and len(d) >= 9 and bool(_ACCOUNT.search(text, max(0, a - 40), a)),
            bool(before and before in " .-" and before in s and text[a - 2 : a - 1].isdigit()) or bool(after and after in " .-" and after in s and text[b + 1 : b + 2].isdigit()),
        ],
        float,
    )


class Segmenter:
    """Weights: per type and feature, and per pair of adjacent types (0 is none, a single atom)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @staticmethod
    def segments(text: str):
        """For each atom its end and the segments (start atom, features) ending there that may be an entity. Only the last LONGEST atoms are held."""
        recent: deque = deque(maxlen=LONGEST)  # atom, where it starts, may it begin an entity, digits, at signs and words "at" before it
        digits = signs = ats = 0
        for j, m in enumerate(_ATOM.finditer(text)):
            a, b = m.span()
            c = text[a]
            recent.append((j, a, c.isalnum() or c in "+(", digits, signs, ats))
            digits += b - a if "0" <= c <= "9" else 0
            signs += c == "@"
            ats += b - a == 2 and m[0].lower() == "at"
            found = []
            if text[b - 1].isalnum() or text[b - 1] in ")]":
                for i, start, begins, d, at, spelt in recent:
                    if i > j - 2:
                        break
                    if begins and (signs > at or digits - d >= 7 or (ats > spelt and _SPELT.fullmatch(text, start, b))):
                        found.append((i, span_features(text, start, b)))
            if b - a >= 9:
                found.append((j, span_features(text, a, b)))
            yield b, found

    @staticmethod
    def lattice(text: str):
        """Atom bounds and, for each end, the segments (start atom, features) that may be an entity."""
        return [m.span() for m in _ATOM.finditer(text)], [found for _, found in Segmenter.segments(text)]

    def scores(self, ends):
        return [[(i, self.weights @ f) for i, f in each] for each in ends]

    def decode(self, text: str) -> list[tuple[int, int, int]]:
        """Best segmentation: (kind number, start, end). Features and scores are held for the last LONGEST atoms, per atom only where its best came from."""
        if not any(found for _, found in self.segments(text)):
            return []
        kinds = len(KINDS) + 1
        row = np.full(kinds, -np.inf)
        row[0] = 0
        best = deque([row], maxlen=LONGEST + 1)  # best[-1] belongs to the place before atom j
        at, starts, before = array("q", [0]), array("q"), bytearray()
        for j, (end, found) in enumerate(self.segments(text)):
            at.append(end)
            row, come, kind = np.full(kinds, -np.inf), [j] * kinds, [0] * kinds
            into = best[-1] + self.moves[:, 0]
            kind[0] = int(into.argmax())
            row[0] = into[kind[0]]
            for i, f in found:
                into = best[i - j - 1][:, None] + self.moves[:, 1:] + (self.weights @ f)[None, :]
                top = into.argmax(0)
                for y in range(len(KINDS)):
                    if into[top[y], y] > row[y + 1]:
                        row[y + 1], come[y + 1], kind[y + 1] = into[top[y], y], i, int(top[y])
            best.append(row)
            starts.extend(come)
            before.extend(kind)
        j, y, out = len(at) - 1, int(row.argmax()), []
        while j:
            slot = (j - 1) * kinds + y
            if y:
                out.append((y - 1, at[starts[slot]], at[j]))
            j, y = starts[slot], before[slot]
        return out[::-1]

    def gradient(self, lattice, gold: dict):
        """Observed minus expected counts for one island; gold: {(start atom, end atom): kind number}."""
        bounds, ends = lattice
        n, kinds = len(bounds), len(KINDS) + 1
        scored = self.scores(ends)
        arcs = [[] for _ in range(n + 1)]
        for j in range(n):
            arcs[j + 1].append((j, 0, 0.0, None))
            for (i, s), (_, f) in zip(scored[j], ends[j]):
                arcs[j + 1] += [(i, y + 1, s[y], f) for y in range(kinds - 1)]
        alpha, beta = np.full((n + 1, kinds), -1e30), np.full((n + 1, kinds), -1e30)
        alpha[0, 0] = 0
        for j in range(1, n + 1):
            for i, y, s, _ in arcs[j]:
                alpha[j, y] = np.logaddexp(alpha[j, y], np.logaddexp.reduce(alpha[i] + self.moves[:, y]) + s)
        beta[n] = 0
        for j in range(n, 0, -1):
            for i, y, s, _ in arcs[j]:
                beta[i] = np.logaddexp(beta[i], self.moves[:, y] + s + beta[j, y])
        z = np.logaddexp.reduce(alpha[n])
        gw, gm = np.zeros_like(self.weights), np.zeros_like(self.moves)
        for j in range(1, n + 1):
            for i, y, s, f in arcs[j]:
                p = np.exp(alpha[i] + self.moves[:, y] + s + beta[j, y] - z)
                gm[:, y] -= p
                if y:
                    gw[y - 1] -= p.sum() * f
        j, last = 0, 0
        while j < n:
            hit = next(((b, y) for (a, b), y in gold.items() if a == j), None)
            if hit is None:
                j, y = j + 1, 0
            else:
                f = next(f for i, f in ends[hit[0]] if i == j)
                y = hit[1] + 1
                gw[y - 1] += f
                j = hit[0] + 1
            gm[last, y] += 1
            last = y
        return gw, gm


def _written(r: Random):
    """(text, [(kind number, start, end)]) of one training island."""
    word = lambda k=6: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, k)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(valid):
        while True:
            d = num(r.choice((13, 15, 16, 16, 16, 19)))
            if luhn(d) == valid:
                break
        sep = r.choice(("", "", " ", "-"))
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))

    def ip(top):
        return ".".join(str(r.randint(0, 255)) for _ in range(3)) + "." + str(r.randint(*top))

    def phone():
        sep = r.choice((" ", "-", "."))
        area = r.choice((f"({num(3)}) ", num(3) + sep))
        return r.choice((f"+{num(r.randint(1, 2))} ", f"+{num(1)}-", "")) + area + num(3) + sep + num(4)

    def email():
        return word(9) + r.choice(("", ".", "_", "+")) + r.choice(("", num(2), word())) + "x@" + word() + num(r.randint(0, 2)) + "." + r.choice(("example.com", word(3), "co.uk"))

    def spelt():
        return f"{word()} {r.choice(('[at]', '(at)'))} {word()} {r.choice(('[dot]', '(dot)', '.'))} {word(3)}".replace(" . ", ".")

    choices = [(0, email), (0, email), (0, spelt), (1, lambda: ip((0, 255))), (2, lambda: card(True)), (2, lambda: card(True)), (3, phone), (3, phone)]
    account = lambda: f"{r.choice(('DE', 'GB', 'FR', 'ES', 'NL'))}{num(2)} " + " ".join(num(4) for _ in range(r.randint(3, 5))) + r.choice(("", " " + num(2)))
    negative = [account, lambda: card(False), lambda: card(False).replace(" ", ""), lambda: ip((256, 999)), lambda: num(r.randint(1, 8)), lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: f"{r.randint(1900, 2030)}-{num(2)}-{num(2)}", lambda: word() + "@" + word(), lambda: num(r.randint(20, 30)), lambda: f"{num(3)} {num(5)} {num(2)}"]
    text, spans = "", []
    for _ in range(r.randint(1, 3)):
        text += r.choice(("", word() + num(1) + " ", num(2) + ". ")) if not text else r.choice((" ", ", 1 ", " " + num(1) + " "))
        if r.random() < 0.6:
            kind, make = r.choice(choices)
            s = make()
            spans.append((kind, len(text), len(text) + len(s)))
        else:
            s = r.choice(negative)()
        text += s + r.choice(("", "", "", ".", ",", "!!", "%%%", "###"))
    return text, spans


@lru_cache(maxsize=1)
def trained(seed: int = 7) -> Segmenter:
    r = Random(seed)
    model = Segmenter(np.zeros((len(KINDS), len(FEATURES))), np.zeros((len(KINDS) + 1, len(KINDS) + 1)))
    data = []
    while len(data) < TRAINING:
        text, spans = _written(r)
        lattice = model.lattice(text)
        begin, end = ({s[k]: n for n, s in enumerate(lattice[0])} for k in (0, 1))
        gold = {(begin[a], end[b]): y for y, a, b in spans if a in begin and b in end}
        if len(gold) == len(spans) and len(lattice[0]) <= 60 and all(any(i == a for i, _ in lattice[1][b]) for a, b in gold):
            data.append((lattice, gold))
    square = [np.full_like(model.weights, 1e-3), np.full_like(model.moves, 1e-3)]
    for _ in range(EPOCHS):  # AdaGrad, small batches
        r.shuffle(data)
        for k in range(0, len(data), 12):
            grads = [model.gradient(*x) for x in data[k : k + 12]]
            for w, sq, g in ((model.weights, square[0], sum(g for g, _ in grads) - 0.01 * model.weights), (model.moves, square[1], sum(g for _, g in grads) - 0.01 * model.moves)):
                sq += g * g
                w += 0.5 * g / np.sqrt(sq)
    return model


def find_spans(text: str, model: Segmenter) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans by kind, then start)."""
    base = base_spans(text)
    starts, ends, more = [], [], []  # the places under base spans, as disjoint stretches
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for first, last in islands(text):
        if last - first < 9:
            continue
        for kind, a, b in model.decode(text[first:last]):
            a, b = a + first, b + first
            k = bisect_right(ends, a)
            if k == len(starts) or starts[k] >= b:
                more.append((kind, a, b))
    return base, sorted(base + more)


def _spans(model: Segmenter):
    kind = pa.struct({"kind": pa.string(), "start": pa.int32(), "end": pa.int32()})

    def run(batches):
        for batch in batches:
            base, every = [], []
            for text in batch.column(1):
                found = find_spans(text.as_py() or "", model)
                for out, spans in zip((base, every), found):
                    out.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(kind)), pa.array(every, pa.list_(kind))], names=["doc_id", "base", "spans"])

    return run


def detect(docs: DataFrame, model: Segmenter | None = None) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) in code points, by kind, then start; one row per row of docs.

    A null text has none. Repeated rows and null ids stay. Other columns are ignored. An empty table gives an empty one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    spans = "array<struct<kind: string, start: int, end: int>>"
    return rows.mapInArrow(_spans(model or trained()), f"doc_id long, base {spans}, spans {spans}")


def masked(text: str, spans) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the one that starts first, then the longer."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
            at = b
        elif b > at:
            at = b  # what sticks out of an overlap is hidden too
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Segmenter | None = None) -> DataFrame:
    """docs with the spans in text replaced; n_chars follows where a text changes. All columns stay."""
    model = model or trained()

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text")).to_pylist()
            new = [t if t is None else masked(t, find_spans(t, model)[1]) for t in texts]
            columns = dict(zip(names, batch.columns))
            columns["text"] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in columns:
                counts = [n if a == b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), texts, new)]
                columns["n_chars"] = pa.array(counts, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)
