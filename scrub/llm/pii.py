"""Personal data: four patterns, and a linear-chain conditional random field over word shapes.

The field tags the words of a line as other, email, ip, card or phone.  A word's features are its shape (runs of
capitals, letters and digits, the latter with their length) and what it holds; its neighbours' classes count too.  It is
trained on a small labelled table of templates and made-up values, by gradient ascent on the exact conditional
likelihood (forward-backward), and decoded by Viterbi, in numpy, over a batch of lines at once.  It adds what the
patterns miss, such as phone numbers without a country code or card numbers in uncommon groups.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrub.llm.common import col, map_slices, text_of
from scrub.llm.spans import SPAN, count_of, listed, untouched

KINDS = ("email", "ip", "card", "phone")
TAGS = ("other", *KINDS)

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches, found from their @: linear however long the run before it."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        m = DOMAIN.match(text, at)
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            yield start, m.end()
            end = at = m.end()
        else:
            at += 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of the patterns: leftmost, non-overlapping for each kind; failing matches are dropped."""
    out = [(s, 0, e, "email") for s, e in _emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    if "+" in text:
        out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


# The labelled table: templates whose slots are filled by rule. A slot's words all carry its tag.
TEMPLATES = (
    "please call {phone} today", "call me on {phone} or {phone}", "phone: {phone}", "tel {phone} and ask for him", "his number is {phone}, she said.",
    "fax {phone} fax", "reach us under {phone}.", "{phone}", "mail {email} for more", "write to {email} or {email}", "e-mail: {email}", "contact {email}, please.",
    "{email}", "sent from {email} by the team", "the host {ip} is down", "ping {ip} and {ip}", "from {ip} to {ip}.", "login at {ip}", "{ip}",
    "paid with card {card} in may", "card: {card}", "number {card} was charged", "{card}", "the {card} card, not valid", "a sum of {plain} was paid",
    "in {plain} they met {plain} times", "page {plain} of {plain}", "version {plain} is out", "nothing to see here", "The sum, as ever, is open.", "token = {plain}",
    "see {plain} and {plain}, or not", "{plain}", "row | {plain} | {plain} | end", "at {plain} h on {plain}", "Words only. And More, with (some) marks!",
)


def _value(kind: str, r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda a=3, b=8: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    if kind == "phone":
        return r.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"{d(3)} {d(3)} {d(4)}"])
    if kind == "email":
        return r.choice([f"{w()}.{d(2)}@{w()}{d(1)}.{w()}.com", f"{w()}@{w()}.org", f"{w()}_{w()}@{w()}.{w(2, 3)}", f"<{w()}@{w()}.net>", f"{w()}@{w()}"])
    if kind == "ip":
        ip = ".".join(str(r.randint(0, 255)) for _ in range(4))
        return r.choice([ip, f"{ip}:{d(4)}", f"[{ip}]", f"{ip}/{d(2)}"])
    if kind == "card":
        return r.choice([d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"{d(4)} {d(6)} {d(5)}"])
    hexa = "".join(r.choice("0123456789abcdef") for _ in range(24))
    return r.choice([d(r.randint(1, 4)), f"{d(2)}.{d(2)}", f"{d(4)}-{d(2)}-{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", f"{d(1)},{d(3)}.{d(2)}", f"{d(2)}%", hexa, f"x{d(3)}y", f"{d(2)}:{d(2)}", f"#{d(5)}", f"{w()}-{d(2)}", f"({d(4)})", f"{d(20)}"])


def labelled_table(rows: int = 600, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """(words, tags) of `rows` sentences from the templates."""
    r, out = random.Random(seed), []
    for i in range(rows):
        words, tags = [], []
        for part in re.split(r"(\{\w+\}[.,]?)", TEMPLATES[i % len(TEMPLATES)]):
            slot = re.match(r"\{(\w+)\}(.?)", part)
            found = (_value(slot[1], r) + slot[2]).split() if slot else part.split()
            tag = TAGS.index(slot[1]) if slot and slot[1] in TAGS else 0
            words += found
            tags += [tag] * len(found)
        out.append((words, tags))
    return out


def shape(word: str) -> str:
    """Runs of capitals as X, of letters as x, of digits as d and their number; other characters as they are."""
    short = re.sub(r"[0-9]+", lambda m: f"\x00{min(len(m[0]), 9)}", word)
    short = re.sub(r"[A-Z]+", "X", short)
    return re.sub(r"[^\W\d_X]+", "x", short).replace("\x00", "d")


#: Classes of words as their neighbours see them; the last is the line's end.
CLASSES = ("plain", "digits", "plus", "paren", "at", "mixed", "end")


def word_class(word: str) -> int:
    has_digit = any("0" <= c <= "9" for c in word)
    if "@" in word:
        return 4
    if not has_digit:
        return 0
    if word[0] == "+":
        return 2
    if word[0] == "(":
        return 3
    return 1 if not any(c.isalpha() for c in word) else 5


def word_features(word: str) -> list[str]:
    """Features of a word.  Words without a digit and an @ have only those of PLAIN, whatever they are."""
    kind = CLASSES[word_class(word)]
    if kind == "plain":
        return ["plain", "capital"] if word[:1].isupper() else ["plain"]
    n = sum("0" <= c <= "9" for c in word)
    return [f"class {kind}", f"shape {shape(word.strip('.,;:!?#$%&*<>[]'))}", f"digits {min(n, 12)}", f"dots {min(word.count('.'), 4)}", f"dashes {min(word.count('-'), 4)}"]


PLAIN = ("plain", "capital")


@dataclass
class Field:
    """Weights of a trained field."""

    own: dict[str, np.ndarray]
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray
    skips_plain: bool = False

    def word(self, word: str) -> np.ndarray:
        total = np.zeros(len(TAGS))
        for f in word_features(word):
            if f in self.own:
                total += self.own[f]
        return total


def _forward_backward(e: np.ndarray, moves: np.ndarray, mask: np.ndarray):
    """Log partition, tag and move marginals of padded sequences (B, T, K)."""
    b, t, k = e.shape

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    alpha, beta = np.zeros((b, t, k)), np.zeros((b, t, k))
    alpha[:, 0] = e[:, 0]
    for i in range(1, t):
        now = lse(alpha[:, i - 1, :, None] + moves, 1) + e[:, i]
        alpha[:, i] = np.where(mask[:, i, None], now, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        now = lse(moves + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        beta[:, i] = np.where(mask[:, i + 1, None], now, 0)
    z = lse(alpha[:, -1], 1)
    tags = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
    pair = alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
    return z, tags, (np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))


def train(table: list[tuple[list[str], list[int]]], rounds: int = 150, rate: float = 0.2, decay: float = 2e-3) -> Field:
    """Weights that maximise the table's conditional likelihood, with a ridge penalty; Adam steps over the whole table."""
    names = sorted({f for words, _ in table for w in words for f in word_features(w)} | set(PLAIN))
    place = {f: i + 1 for i, f in enumerate(names)}
    b, t, k, width = len(table), max(len(w) for w, _ in table), len(TAGS), 5
    ids, tags = np.zeros((b, t, width), int), np.zeros((b, t), int)
    near = np.full((b, t + 2), CLASSES.index("end"))
    mask = np.zeros((b, t), bool)
    for i, (words, marks) in enumerate(table):
        mask[i, : len(words)] = True
        tags[i, : len(words)] = marks
        for j, w in enumerate(words):
            fs = [place[f] for f in word_features(w)]
            ids[i, j, : len(fs)] = fs
            near[i, j + 1] = word_class(w)
    gold = np.eye(k)[tags] * mask[:, :, None]
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (tags[:, :-1][mask[:, 1:]], tags[:, 1:][mask[:, 1:]]), 1)
    shapes = [(len(names) + 1, k), (len(CLASSES), k), (len(CLASSES), k), (k, k)]
    weights, m1, m2 = ([np.zeros(s) for s in shapes] for _ in range(3))
    for step in range(1, rounds + 1):
        own, before, after, moves = weights
        own[0] = 0
        e = own[ids].sum(axis=2) + before[near[:, :-2]] + after[near[:, 2:]]
        _, p, p_moves = _forward_backward(e, moves, mask)
        d = (gold - p).reshape(-1, k)
        grads = [np.zeros(s) for s in shapes]
        for j in range(width):
            np.add.at(grads[0], ids[:, :, j].ravel(), d)
        np.add.at(grads[1], near[:, :-2].ravel(), d)
        np.add.at(grads[2], near[:, 2:].ravel(), d)
        grads[3] = gold_moves - p_moves
        for w, g, a, c in zip(weights, grads, m1, m2):
            g = g / b - decay * w
            a += 0.1 * (g - a)
            c += 0.01 * (g * g - c)
            w += rate * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.99**step)) + 1e-8)
    own, before, after, moves = weights
    own[0] = 0
    out = Field({f: own[i] for f, i in place.items()}, before, after, moves)
    out.skips_plain = _all_other(out)
    return out


def _all_other(model: Field) -> bool:
    """Whether a line of plain words is tagged other throughout, for every such line.

    Compares the best that any stretch of other tags could win over a line of other: the heaviest walk among these tags,
    each word counted with its most favourable features, from one end of the stretch to the other.
    """
    words = [model.own["plain"], model.own["plain"] + model.own["capital"]]
    ends = [CLASSES.index("plain"), CLASSES.index("end")]
    win = np.max([w + model.before[p] + model.after[q] for w in words for p in ends for q in ends] - np.array([[w[0] + model.before[p][0] + model.after[q][0]] for w in words for p in ends for q in ends]), axis=0)[1:]
    moves = model.moves - model.moves[0, 0]
    walk = moves[1:, 1:] + win
    for k in range(len(win)):
        walk = np.maximum(walk, walk[:, k : k + 1] + walk[k : k + 1, :])
    if walk.diagonal().max() >= 0:
        return False
    np.fill_diagonal(walk, 0)
    enter, leave = win + np.maximum(0, moves[0, 1:]), np.maximum(0, moves[1:, 0])
    return bool((enter[:, None] + walk + leave).max() < 0)


def viterbi(e: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tags of padded sequences (B, T, K), all sequences a step at a time."""
    b, t, k = e.shape
    back = np.zeros((b, t, k), np.int8)
    score = e[:, 0]
    rows = np.arange(b)
    for i in range(1, t):
        at = score[:, :, None] + moves
        best = at.argmax(axis=1)
        now = at.max(axis=1) + e[:, i]
        live = (i < lengths)[:, None]
        back[:, i] = np.where(live, best, np.arange(k))
        score = np.where(live, now, score)
    out = np.zeros((b, t), np.int8)
    out[:, -1] = score.argmax(axis=1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = back[rows, i, out[:, i]]
    return out


#: Words of a piece: a longer line is cut after the next plain word, and at twice as many in any case.
PIECE = 96
#: Pieces decoded together.
TOGETHER = 2048
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TELLS = re.compile(r"[0-9@]")
_TRIM = ".,;:!?#$%&*<>[]\"'"


class Tagger:
    """Decoder of batches of texts, with each word's score remembered."""

    LIMIT = 200_000

    def __init__(self, model: Field):
        self.model, self.rows, self.table = model, {}, []

    def row(self, word: str) -> int:
        at = self.rows.get(word)
        if at is None:
            at = self.rows[word] = len(self.table)
            self.table.append((self.model.word(word), word_class(word)))
        return at

    def pieces(self, text: str) -> Iterator[list[tuple[int, int, str]]]:
        """Lines as (start, end, word); lines that are tagged other throughout by proof are left out."""
        start = 0
        while start <= len(text):
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
            if not self.model.skips_plain or _TELLS.search(text, start, end):
                piece: list[tuple[int, int, str]] = []
                for m in _WORD.finditer(text, start, end):
                    piece.append((m.start(), m.end(), m[0]))
                    if len(piece) >= 2 * PIECE or len(piece) >= PIECE and not _TELLS.search(m[0]):
                        yield piece
                        piece = []
                if piece:
                    yield piece
            start = end + 1

    def tag(self, texts) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the tagged stretches of each text."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
        waiting: list[tuple[int, list[tuple[int, int, str]]]] = []
        for i, text in enumerate(texts):
            for piece in self.pieces(text):
                waiting.append((i, piece))
                if len(waiting) >= TOGETHER:
                    self._decode(waiting, out)
                    waiting = []
        if waiting:
            self._decode(waiting, out)
        return [sorted(x) for x in out]

    def _decode(self, pieces, out) -> None:
        pieces = sorted(pieces, key=lambda p: len(p[1]))
        if len(self.table) > self.LIMIT:
            self.rows, self.table = {}, []
        for at in range(0, len(pieces), 256):
            some = pieces[at : at + 256]
            lengths = np.array([len(p) for _, p in some])
            t, end = int(lengths.max()), CLASSES.index("end")
            ids = [[self.row(w) for _, _, w in p] for _, p in some]
            e = np.zeros((len(some), t, len(TAGS)))
            near = np.full((len(some), t + 2), end)
            for r, row in enumerate(ids):
                e[r, : len(row)] = [self.table[x][0] for x in row]
                near[r, 1 : len(row) + 1] = [self.table[x][1] for x in row]
            e += self.model.before[near[:, :-2]] + self.model.after[near[:, 2:]]
            tags = viterbi(e, self.model.moves, lengths)
            for (i, piece), marks in zip(some, tags):
                out[i] += _stretches(piece, marks)


def _stretches(piece, marks) -> list[tuple[int, int, str]]:
    found, j = [], 0
    while j < len(piece):
        k = j + 1
        if marks[j]:
            while k < len(piece) and marks[k] == marks[j]:
                k += 1
            start, end = piece[j][0], piece[k - 1][1]
            first, last = piece[j][2], piece[k - 1][2]
            start += len(first) - len(first.lstrip(_TRIM))
            end -= len(last) - len(last.rstrip(_TRIM))
            if start < end:
                found.append((start, end, TAGS[marks[j]]))
        j = k
    return found


def scan_personal(docs: DataFrame, model: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, base, added): spans of the patterns, and the field's that touch none of these.

    Null texts count as empty and have no spans.  Texts are scanned whole in one pass without a shuffle; repeated
    rows get the same spans each.  An empty table gives no rows; other columns are ignored.
    """
    field = model or train(labelled_table())
    slim = docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    name = ("start", "rank", "end", "kind")

    def make():
        tagger = Tagger(field)

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            base = [base_spans(t) for t in batch["text"]]
            added = []
            for own, marks in zip(base, tagger.tag(batch["text"].tolist())):
                free = untouched(own)
                added.append([dict(zip(name, (s, len(KINDS) + KINDS.index(k), e, f"crf_{k}"))) for s, e, k in marks if free(s, e)])
            return pd.DataFrame({"doc_id": batch["doc_id"], "base": [[dict(zip(name, s)) for s in b] for b in base], "added": added})

        return run

    return map_slices(slim, make, f"doc_id {kind}, base {SPAN}, added {SPAN}")


def personal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of `scan_personal` as counts, a digest of the base spans and one list of all."""
    rows = scan_personal(docs, None, id_col, text_col)
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
