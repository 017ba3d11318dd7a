"""Personal data by a skip-chain conditional random field.

*Base spans* come from one pattern and one check for each kind (email, ip,
card, phone). A pattern that swallows too much fails its check, and what it
covered is lost; other mentions are written in a form no pattern covers. The
field finds such tokens from their form, their neighbours and the labels of
the same or similar tokens elsewhere in the document.

*Field.* Its nodes are the words that hold a digit or ``@``; all other words
have the label O by definition, so they only close a chain. A label is O, a
kind, or the inside of a kind written in several words (card, phone).
Potentials: features of a word's form and of its neighbours' forms; pairs of
labels of adjacent words; and *skip* edges, which reward equal labels of each
word and the next one in the document that repeats it (or, with a weight of
its own, is similar: the same letters and digits, the same last digits of a
number, the same name before an ``@``). Linking only consecutive
occurrences keeps the edges linear in the words and still ties all of them.

*Learning* maximises the pseudo-likelihood of the base labels, which are no
features, on a bounded sample of documents; words inside a match that failed
its check are unlabelled there. The prior pulls all weights towards 0, but
those of the skip edges towards a reward for agreement (``AGREE``): where no
document of the sample repeats a word, repeated words still agree. *Inference* is loopy sum-product with
damping over a batch's words at once; words of base spans are observed.

*Spans.* A run of words whose label has a marginal of ``SURE`` or more is
added if it overlaps no base span and holds what its kind must (digits and
check sum, four parts, both sides of the ``@``). A run that lacks its first
word needs a skip edge, direct or through others, to a word of a base span.
Base spans always stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_id_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", "email", "ip", "card", "card+", "phone", "phone+")     # + : inside a span
O, N_LABELS = 0, len(LABELS)
BITS = 12                 # form features are hashed to 2 ** BITS weights a label
SAMPLE = 5_000            # documents with a digit or @ that the field is fitted on, at most
SAMPLE_CHARS = 1 << 16    # only documents up to this length are drawn for the sample
SHARED_DIGITS = 7         # numbers with so many equal last digits are similar
SURE = 0.9
AGREE = (3.0, 2.0)        # prior reward of equal labels: same word, similar word
ROUNDS, DAMPING, STILL = 60, 0.5, 1e-4
EDGE_CHARS = "\"'`.,;:!?<>[]{}*#$%&=|/\\_~^-"    # stripped from the ends of a word

_MARKED = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs: the same matches as the plain patterns, in linear time on long runs of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_FORM = re.compile(r"[0-9]+|[^\W\d_]+|[^0-9]", re.S)


def digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _valid_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))


def _valid_card(text: str) -> bool:
    d = digits(text) if len(text) < 64 else ""
    return 16 <= len(d) <= 19 and luhn(d)


def _valid_phone(text: str) -> bool:
    return 8 <= len(_DIGIT.findall(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern: at each ``@`` with a domain,
    the run of local characters before it, not into the match before."""
    done = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """((kind, start, end) of the base spans, ranges of dropped matches);
    code points, end exclusive."""
    if not _MARKED.search(text):
        return [], []
    found = [(0, i, j) for i, j in emails(text)] if "@" in text else []
    dropped = []
    for kind, pattern, valid in ((1, _IP, _valid_ip), (2, _CARD, _valid_card), (3, _PHONE, _valid_phone)):
        for m in pattern.finditer(text):
            if valid(m.group()):
                found.append((kind, *m.span()))
            elif m.end() - m.start() >= 8:
                dropped.append(m.span())
    return found, dropped


def form(word: str) -> tuple[str, str]:
    """(form with the lengths of its digit runs, form without): runs of
    digits and letters by one sign each, all other characters as they are."""
    fine, coarse = [], []
    for run in _FORM.findall(word[:64]):
        c = run[0]
        if "0" <= c <= "9":
            fine.append(f"9{min(len(run), 20)}")
            coarse.append("9")
        elif c.isalpha():
            fine.append("a")
            coarse.append("a")
        else:
            fine.append(c)
            coarse.append(c)
    return " ".join(fine), "".join(coarse)


@dataclass
class Words:
    """The nodes of several documents: ``doc``, core ``start`` and ``end``,
    ``forms`` (feature numbers, a row of six per node), ``chained`` (the node
    before is the word before), ``again`` and ``alike`` (index of the next
    node of the document with the same core, or the same letters and digits;
    -1 if none), ``label`` (-1: unlabelled) and ``seen`` (in a base span)."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    forms: np.ndarray
    chained: np.ndarray
    again: np.ndarray
    alike: np.ndarray
    label: np.ndarray
    seen: np.ndarray


def _number(kind: str, text: str) -> int:
    return zlib.crc32(f"{kind}{text}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def likeness(core: str) -> str:
    """What similar words have in common; empty for words of no account."""
    if "@" in core:
        return core[:core.index("@") + 1].lower()
    plain = "".join(c for c in core[:256] if c.isalnum()).lower()
    if len(plain) >= SHARED_DIGITS and plain.isdecimal():
        return plain[-SHARED_DIGITS:]
    return plain if len(plain) >= 4 else ""


def _cores(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end of the word; start, end of its core) of every word that
    holds a digit or @."""
    done = 0
    for m in _MARKED.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not _SPACE.match(text, start - 1):
            start -= 1
        after = _SPACE.search(text, m.end())
        done = after.start() if after else len(text)
        i, j = start, done
        while text[i] in EDGE_CHARS:
            i += 1
        while text[j - 1] in EDGE_CHARS:
            j -= 1
        yield start, done, i, j


def collect(texts: list[str], bases: list[tuple[list, list]]) -> Words:
    rows, forms, again, alike = [], [], [], []
    for d, (text, (spans, dropped)) in enumerate(zip(texts, bases)):
        words = list(_cores(text)) if _MARKED.search(text) else []
        if not words:
            continue
        held = sorted((i, j, kind) for kind, i, j in spans)
        lost = sorted(dropped)
        shapes = [form(text[i:j]) for _, _, i, j in words]
        first, last_same, last_like = len(rows), {}, {}
        at = gone = 0
        joined = [k > 0 and (g := _SPACES.match(text, words[k - 1][1])) is not None and g.end() == words[k][0] for k in range(len(words))]
        for k, (_, _, i, j) in enumerate(words):
            while at < len(held) and held[at][1] <= i:
                at += 1
            while gone < len(lost) and lost[gone][1] <= i:
                gone += 1
            label = -1 if gone < len(lost) and lost[gone][0] < j else O
            seen = at < len(held) and held[at][0] < j
            if seen:
                b, e, kind = held[at]
                inside = kind >= 2 and k > 0 and words[k - 1][3] > b
                label = LABELS.index(KINDS[kind]) + (1 if inside else 0)
            fine, coarse = shapes[k]
            before = shapes[k - 1][1] if joined[k] else "w"
            after = shapes[k + 1][1] if k + 1 < len(words) and joined[k + 1] else "w"
            forms.append([_number("f", fine), _number("c", coarse), _number("b", f"{before} {coarse}"), _number("a", f"{coarse} {after}"),
                          _number("n", str(min(24, sum(c.isdigit() for c in text[i:min(j, i + 64)])))), _number("s", text[i] if not text[i].isalnum() else "x")])
            core = text[i:j]
            plain = likeness(core)
            again.append(-1)
            alike.append(-1)
            n = first + k
            if core in last_same:
                again[last_same[core]] = n
            elif plain and plain in last_like:
                alike[last_like[plain]] = n
            last_same[core] = last_like[plain] = n           # the empty likeness is never looked up
            rows.append((d, i, j, joined[k], label, seen))
    cols = list(zip(*rows)) if rows else [()] * 6
    ints = [np.array(c, np.int64) for c in (cols[0], cols[1], cols[2], again, alike, cols[4])]
    return Words(ints[0], ints[1], ints[2], np.array(forms, np.int64).reshape(-1, 6), np.array(cols[3], bool), ints[3], ints[4], ints[5],
                 np.array(cols[5], bool))


@dataclass
class Field:
    """``forms`` (2 ** BITS x labels), ``steps`` (label before x label),
    ``again`` and ``alike`` (reward of each equal label on a skip edge)."""

    forms: np.ndarray
    steps: np.ndarray
    again: np.ndarray
    alike: np.ndarray

    @classmethod
    def empty(cls) -> Field:
        return cls(np.zeros((1 << BITS, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros(N_LABELS), np.zeros(N_LABELS))

    def local(self, w: Words) -> np.ndarray:
        """Log potentials of the nodes; a word that no node precedes or
        follows has the neighbour O."""
        out = self.forms[w.forms].sum(1)
        followed = np.append(w.chained[1:], False) if len(w.chained) else w.chained
        out[~w.chained] += self.steps[O]
        out[~followed] += self.steps[:, O]
        return out

    def edges(self, w: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(from, to, log potential by labels) of the chain and skip edges."""
        to = np.flatnonzero(w.chained)
        out = [(to - 1, to, self.steps)]
        for reward, link in ((self.again, w.again), (self.alike, w.alike)):
            a = np.flatnonzero(link >= 0)
            out.append((a, link[a], np.diag(reward)))
        return out


def neighbours(w: Words, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a node's neighbours say, as sums of one-hot labels (rows of
    zeros for unlabelled ones): before, after, again, alike."""
    hot = np.zeros((len(y) + 1, N_LABELS))
    hot[np.flatnonzero(y >= 0), y[y >= 0]] = 1
    n = len(y)
    prev = np.where(w.chained, np.arange(n) - 1, n)
    follows = np.append(w.chained[1:], False) if n else w.chained
    nxt = np.where(follows, np.arange(n) + 1, n)
    before, after = hot[prev], hot[nxt]
    before[~w.chained, O] = 1
    after[~follows, O] = 1
    skips = []
    for link in (w.again, w.alike):
        a = np.flatnonzero(link >= 0)
        s = np.zeros((n, N_LABELS))
        np.add.at(s, a, hot[link[a]])
        np.add.at(s, link[a], hot[a])
        skips.append(s)
    return before, after, *skips


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def gradient(f: Field, w: Words, said: tuple, reg: float) -> tuple[float, Field]:
    """The regularised negative log pseudo-likelihood and its gradient."""
    before, after, again, alike = said
    use = np.flatnonzero(w.label >= 0)
    score = f.forms[w.forms[use]].sum(1) + before[use] @ f.steps + after[use] @ f.steps.T + again[use] * f.again + alike[use] * f.alike
    p = softmax(score)
    y = w.label[use]
    loss = -np.log(np.maximum(p[np.arange(len(use)), y], 1e-300)).sum()
    p[np.arange(len(use)), y] -= 1
    g = Field.empty()
    for k in range(w.forms.shape[1]):
        np.add.at(g.forms, w.forms[use, k], p)
    g.steps = before[use].T @ p + (after[use].T @ p).T
    g.again, g.alike = (again[use] * p).sum(0), (alike[use] * p).sum(0)
    for name, prior in (("forms", 0.0), ("steps", 0.0), ("again", AGREE[0]), ("alike", AGREE[1])):
        value = getattr(f, name) - prior
        loss += reg / 2 * float((value * value).sum())
        setattr(g, name, getattr(g, name) + reg * value)
    return float(loss), g


def learn(w: Words, reg: float = 0.05, rounds: int = 300, rate: float = 0.1) -> Field:
    """Weights by Adam on the whole sample; without words all are zero."""
    f = Field.empty()
    if not len(w.doc):
        return f
    f.again += AGREE[0]
    f.alike += AGREE[1]
    said = neighbours(w, w.label)
    names = ("forms", "steps", "again", "alike")
    m, v = Field.empty(), Field.empty()
    for t in range(1, rounds + 1):
        _, g = gradient(f, w, said, reg)
        for name in names:
            a, b, d = getattr(m, name), getattr(v, name), getattr(g, name)
            a += 0.1 * (d - a)
            b += 0.001 * (d * d - b)
            getattr(f, name)[...] -= rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
    return f


def marginals(f: Field, w: Words, observe: bool = True) -> np.ndarray:
    """Label marginals of every node by loopy sum-product: all messages are
    renewed at once from the last ones, damped, until they are still (or
    ``ROUNDS``). Words of base spans are observed."""
    n = len(w.doc)
    if not n:
        return np.zeros((0, N_LABELS))
    local = f.local(w)
    if observe:
        fixed = np.flatnonzero(w.seen)
        local[fixed] = -1e3
        local[fixed, w.label[fixed]] = 0
    src, dst, pots = [], [], []
    for a, b, pot in f.edges(w):
        src += [a, b]
        dst += [b, a]
        pots += [(pot, len(a)), (pot.T, len(a))]
    src, dst = np.concatenate(src), np.concatenate(dst)
    back = np.concatenate([np.arange(k) + s for s, k in _turned([k for _, k in pots])]) if len(src) else src
    cuts = np.cumsum([0, *[k for _, k in pots]])
    lift = [np.exp(pot - pot.max()) for pot, _ in pots]
    msg = np.zeros((len(src), N_LABELS))
    for _ in range(ROUNDS if len(src) else 0):
        belief = local.copy()
        np.add.at(belief, dst, msg)
        out = belief[src] - msg[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.concatenate([out[i:j] @ e for i, j, e in zip(cuts, cuts[1:], lift)])
        new = np.log(np.maximum(new, 1e-300))
        new -= new.max(1, keepdims=True)
        change = np.abs(new - msg).max()
        msg += DAMPING * (new - msg)
        if change < STILL:
            break
    belief = local
    np.add.at(belief, dst, msg)
    return softmax(belief)


def _turned(sizes: list[int]) -> list[tuple[int, int]]:
    """(first, size) of each group's opposite: groups come in pairs."""
    first = np.cumsum([0, *sizes])
    return [(int(first[i ^ 1]), sizes[i]) for i in range(len(sizes))]


def plausible(kind: int, text: str) -> bool:
    """What a span of the kind must hold, however it is written."""
    if kind == 0:
        left, _, right = text.partition("@")
        return bool(left) and len(right) > 1 and "@" not in right
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and _valid_ip(text)
    if kind == 2:
        return _valid_card(text)
    return 8 <= len(_DIGIT.findall(text)) <= 15 and not any(c.isalpha() for c in text)


def tied_to_base(w: Words) -> np.ndarray:
    """Which words skip edges connect, directly or not, to a base span."""
    tied = w.seen.copy()
    linked = np.flatnonzero((w.again >= 0) | (w.alike >= 0))
    for order in (linked, linked[::-1]):
        for i in order:
            j = max(w.again[i], w.alike[i])                  # a word has one of the two at most
            tied[i] = tied[j] = tied[i] or tied[j]
    return tied


def added_spans(texts: list[str], w: Words, p: np.ndarray, bases: list[tuple[list, list]]) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of the runs the field is sure of, by document."""
    out = [[] for _ in texts]
    best = p.argmax(1)
    tied = tied_to_base(w)
    sure = (p[np.arange(len(p)), best] >= SURE) & (best != O) & ~w.seen
    n, k = len(best), 0
    while k < n:
        if not sure[k]:
            k += 1
            continue
        name, first = LABELS[best[k]].rstrip("+"), k       # a mention may lack its first word
        k += 1
        while k < n and sure[k] and w.chained[k] and LABELS[best[k]] == f"{name}+":
            k += 1
        d, i, j, kind = int(w.doc[first]), int(w.start[first]), int(w.end[k - 1]), KINDS.index(name)
        whole = not LABELS[best[first]].endswith("+") or tied[first:k].any()
        if whole and plausible(kind, texts[d][i:j]) and not any(a < j and i < b for _, a, b in bases[d][0]):
            out[d].append((kind, i, j))
    return out


def spelt(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for k, i, j in sorted(spans))


def training_texts(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """At most ``sample`` texts with a digit or @, of at most ``SAMPLE_CHARS``
    characters: those least by a hash of id and text, of a draw by that hash
    that leaves about eight documents for each wanted."""
    some = docs.select(F.col(text_col).alias("text"), F.xxhash64(doc_id_text(F.col(id_col)), text_col).alias("h"))
    share = min(1.0, 8 * sample / max(1, docs.count()))
    some = some.filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))).filter(
        F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS))
    return [r[0] for r in some.orderBy("h", "text").limit(sample).select("text").collect()]


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field of a corpus, from ``training_texts``."""
    texts = training_texts(docs, sample, id_col, text_col)
    return learn(collect(texts, [base_spans(t) for t in texts]))


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base
    spans), ``base`` and ``spans`` (``kind:start:end``, by kind and start,
    comma-joined; code points, end exclusive) and n_added.

    Null texts count as empty and hold nothing, like texts without a digit
    or @. Every row is searched by itself, also where ids or texts repeat;
    null ids stay null; extra columns are not read; an empty table gives an
    empty result. A field without weights adds nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)      # 2 ** BITS x labels numbers
    kind = docs.schema[id_col].dataType.simpleString()
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_added"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            w = collect(texts, bases)
            more = added_spans(texts, w, marginals(shared.value, w), bases)
            counts = np.zeros((len(texts), len(KINDS)), np.int64)
            for i, (spans, _) in enumerate(bases):
                for k, _, _ in spans:
                    counts[i, k] += 1
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *[pa.array(counts[:, k].copy()) for k in range(len(KINDS))], pa.array([spelt(b) for b, _ in bases], pa.string()),
                pa.array([spelt(b + m) for (b, _), m in zip(bases, more)], pa.string()), pa.array([len(m) for m in more], pa.int64())], columns)

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(
        search, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long")
