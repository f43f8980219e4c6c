"""Personal data by a character-level bidirectional LSTM with CRF transitions, in numpy.

Every character of every text is read by both directions; their states give a score for each tag (none, or a kind of personal data),
and Viterbi decoding with learned transitions picks the best sequence of tags. Texts are laid out in windows of WINDOW characters that overlap by
OVERLAP. Where two windows overlap, the scores of both are blended, each weighing the more the farther its own end is, and the best tags are then those of the whole document under
one CRF: no window decides anything for itself, so no span is cut, counted twice or given two kinds. That decoding is exact, though it doesn't walk the whole text: for every character a bound tells what the best
run of tags over it can gain against none at all (two running minima over the document); where that is below zero the best sequence has no tag, and the islands that remain are
decoded one by one, side by side. A span that lacks what its kind can't be without (plausible) is dropped.

The model is trained here from labelled spans: those given to train (labelled), or texts composed by training_texts (invented prose, junk and look-alikes, with spans of
personal data whose places are known), by backpropagation through time and the CRF's forward-backward algorithm. Training takes TRAIN_STEPS steps of a fixed seed on the
driver (about a minute of one core) and is kept in the shared folder under a name made of its parameters, so sessions that share the folder train once; the model (20 kB) travels with the tasks.

Padding has no state in either direction, so a text's tags don't depend on what shares its batch.

Cost: one pass over the text without a shuffle, about 0.3 microseconds a character.

Defined cases: a null or empty text has no spans. Spans count characters (code points), end exclusive. Neighbouring spans of one kind without a character between them are one span. Rows are
independent: null ids, ties and repeated rows need no rule. A text of any length is read whole. An empty table gives an empty result. Further columns don't matter.
"""

from __future__ import annotations

import random
import string
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import process_cache, shared_dir

KINDS = ["EMAIL", "PHONE", "IP", "CARD", "SECRET", "ID"]
TAGS = len(KINDS) + 1
HIDDEN = 12
EMBED = 8
WINDOW = 512
OVERLAP = 64
#: Characters in a batch of windows.
BATCH_CHARS = 1 << 20
TRAIN_STEPS = 1200
TRAIN_BATCH = 64
TRAIN_LENGTH = 96
SEED = 11
PAD = 0


def _alphabet() -> np.ndarray:
    """Character ids of the code points up to 0xFFFF: 0 is padding, ASCII has ids of its own, others go by class."""
    import unicodedata

    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if 32 <= c < 127:
            out[c] = c - 30
        elif c == 10:
            out[c] = 1
        else:
            kind = unicodedata.category(chr(c))
            out[c] = 97 if kind in ("Ll", "Lo", "Lm", "Mn", "Mc") else 98 if kind in ("Lu", "Lt") else 99 if kind[0] == "N" else 100 if kind[0] in "ZC" else 101
    return out


VOCABULARY = 102
REST = 101


def alphabet() -> np.ndarray:
    cache = process_cache()
    if "alphabet" not in cache:
        cache["alphabet"] = _alphabet()
    return cache["alphabet"]


def char_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = alphabet()
    return np.where(points < len(table), table[np.minimum(points, len(table) - 1)], REST).astype(np.uint8)


# ---------------------------------------------------------------- labelled spans

_PARTS = {
    "en": ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "ing", "tion", "ly"],
    "fr": ["le", "es", "de", "en", "re", "nt", "on", "er", "te", "el", "an", "se", "et", "la", "ai", "it", "me", "ou", "em", "ie", "é", "è", "ê", "ç", "eau", "aux", "oi", "à"],
    "de": ["en", "er", "ch", "de", "ei", "ie", "in", "te", "ge", "un", "nd", "st", "ä", "ö", "ü", "ß", "ung", "heit", "sch", "tz", "ver", "be"],
    "es": ["de", "en", "os", "ar", "es", "ue", "ra", "re", "er", "as", "on", "st", "ad", "al", "ci", "ión", "ñ", "ll", "í", "ó", "rr", "que", "el", "ja"],
    "xx": ["да", "но", "ст", "ве", "ри", "ра", "ко", "на", "漢", "字", "かな"],
}


class Dice:
    """The few calls of a numpy generator that composing texts needs, many times faster one at a time."""

    def __init__(self, seed: int):
        self.source = random.Random(seed)
        self.random = self.source.random

    def integers(self, low: int, high: int) -> int:
        return low + int(self.random() * (high - low))

    def choice(self, among, p=None):
        among = range(among) if isinstance(among, int) else among
        return self.source.choices(among, p)[0] if p else among[int(self.random() * len(among))]


def _word(rng) -> str:
    parts = _PARTS[rng.choice(["en", "en", "en", "fr", "de", "es", "es", "xx"], p=[0.2, 0.2, 0.1, 0.15, 0.15, 0.1, 0.07, 0.03])]
    return "".join(rng.choice(parts) for _ in range(rng.integers(1, 6) if rng.random() < 0.9 else rng.integers(5, 10)))


def _odd_word(rng) -> str:
    """A word that isn't made of syllables."""
    u = rng.random()
    if u < 0.7:
        return _of(rng, string.ascii_lowercase, int(rng.integers(2, 12)))
    if u < 0.85:
        return _of(rng, string.ascii_uppercase, int(rng.integers(2, 8))) + str(rng.choice(["", "-2.0", "-3.0", " BY-SA 4.0", " BY-NC 4.0", " 3"]))
    return str(rng.choice(["wh", "sh", "th", "nd", "st", "rt", "lt", "ns"])) * int(rng.integers(1, 5)) + str(rng.choice(["", "on", "ea", "ing", "er"]))


def _digits(rng, n: int) -> str:
    return "".join(rng.choice(list(string.digits)) for _ in range(n))


def _of(rng, letters: str, n: int) -> str:
    return "".join(rng.choice(list(letters)) for _ in range(n))


def _latin(rng) -> str:
    return "".join(rng.choice(_PARTS["en"]) for _ in range(rng.integers(1, 5)))


def personal(rng, kind: str) -> tuple[str, str, str]:
    """(text before, the span, text after) of a kind."""
    d = lambda n: _digits(rng, n)
    if kind == "EMAIL":
        name = _latin(rng) if rng.random() < 0.6 else _of(rng, string.ascii_lowercase, int(rng.integers(2, 10)))
        local = name + rng.choice(["", ".", "_", "-", "+"]) + rng.choice([_latin(rng), d(2), d(int(rng.integers(1, 5))), ""])
        local = local.rstrip(".+-_") or "a"
        host = rng.choice(["mail" + d(1), _latin(rng), _latin(rng) + "-" + _latin(rng), "mail." + _latin(rng), _latin(rng) + d(1)]) + rng.choice([".example", "", "", ".co"])
        out = local + "@" + host + "." + rng.choice(["com", "org", "net", "de", "fr", "es", "io", "edu", "info"])
        return "", out.upper() if rng.random() < 0.12 else out.title() if rng.random() < 0.05 else out, ""
    if kind == "PHONE":
        return "", rng.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1 ({d(3)}) 555-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+{d(2)} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)} {d(3)} {d(7)}"]), ""
    if kind == "IP":
        return "", ".".join(str(int(rng.integers(0, 256))) for _ in range(4)), ""
    if kind == "CARD":
        n = rng.choice([1, 1, 1, 2, 3])
        groups = [d(4) for _ in range(4)]
        return "", "".join(groups) if n == 1 else " ".join(groups) if n == 2 else "-".join(groups), ""
    if kind == "SECRET":
        value = rng.choice([_of(rng, "0123456789abcdef", int(rng.choice([32, 40, 40, 64]))), _of(rng, string.ascii_letters + string.digits, int(rng.integers(24, 44))), "AKIA" + _of(rng, string.ascii_uppercase + string.digits, 16), "ghp_" + _of(rng, string.ascii_letters + string.digits, 36), "sk-" + _of(rng, string.ascii_letters + string.digits, 32)])
        if rng.random() < 0.12:
            value = value.upper()
        name = rng.choice(["token", "token", "api_key", "secret", "password", "key", "TOKEN", "access_token", "apikey"])
        a, b = rng.choice([(' = "', '"'), (' = "', '"'), ("='", "'"), (": ", ""), ("=", ""), ('": "', '"')])
        return (name + a, value, b) if rng.random() < 0.9 else ("", value, "")
    return "", f"{d(3)}-{d(2)}-{d(4)}", ""


def look_alike(rng) -> str:
    """What isn't personal data, though it has the characters of it."""
    d = lambda n: _digits(rng, n)
    k = int(rng.integers(0, 24))
    word = _latin(rng)
    return [
        d(int(rng.integers(1, 9))), "20" + d(2), f"{d(1)}.{d(2)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", f"#{d(4)}", f"{d(2)}%", f"${d(3)}.{d(2)}", "@" + word, word + " @ " + word,
        f"https://{word}.example.com/en/{d(3)}?page={d(1)}&ref=x#top", f"{word}.example.org", f"0x{_of(rng, '0123456789abcdef', 4)}", f'"{word}"', f"{word} = {d(2)}", f"Version {d(1)}.{d(1)}", f"Copyright (c) 20{d(2)}", f"({d(3)})", f"{word}.{d(2)}", f"1,{d(3)},{d(3)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", f'{word} = "{word}"',
    ][k]


def training_texts(rng, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, length) character ids and tags of composed texts, each a cut through a longer one."""
    ids, tags = np.zeros((n, length), np.uint8), np.zeros((n, length), np.uint8)
    for i in range(n):
        style = rng.choice(5, p=[0.62, 0.12, 0.1, 0.08, 0.08])  # prose, marks, capitals, bars, lower case
        text, mark = [], []
        size, room = 0, length + int(rng.integers(0, 60))
        dense = rng.random() < 0.6
        while size < room:
            u = rng.random()
            pieces = []
            if dense and u < 0.16:
                kind = int(rng.integers(0, len(KINDS)))
                before, span, after = personal(rng, KINDS[kind])
                pieces = [(before, 0), (span, kind + 1), (after, 0)]
            elif u < 0.24:
                pieces = [(look_alike(rng), 0)]
            else:
                w = _odd_word(rng) if rng.random() < 0.12 else _word(rng)
                if style == 2:
                    w = w.upper()
                elif rng.random() < 0.15 and style != 4:
                    w = w.capitalize()
                pieces = [(w, 0)]
            if style == 1:
                end = rng.choice(["$$$", "###", "%%%", "&&&", "***"]) + " "
            elif style == 2:
                end = rng.choice(["!! ", "!! ", ".\n", ",!! "])
            elif style == 3:
                end = " | "
            else:
                end = rng.choice([" ", ", ", ". ", ".\n", "\n", "; ", ") ", ": ", "\t"], p=[0.72, 0.08, 0.07, 0.06, 0.02, 0.02, 0.01, 0.01, 0.01])
            pieces.append((end, 0))
            for s, k in pieces:
                text.append(s)
                mark += [k] * len(s)
                size += len(s)
        whole = char_ids("".join(text))
        mark = np.array(mark, np.uint8)
        # some begin or end within the row, as texts do
        at = 0 if rng.random() < 0.15 else int(rng.integers(0, max(1, len(whole) - length + 1)))
        if rng.random() < 0.45:
            end = int(rng.integers(4, length + 1))
            whole, mark = whole[at : at + end], mark[at : at + end]
            at = 0
            if rng.random() < 0.7 and not mark[-1]:
                whole[-1] = char_ids(rng.choice([".", ".", ".", ".", "!", "\n", "|", '"', ")"]))[0]
        part = whole[at : at + length]
        ids[i, : len(part)], tags[i, : len(part)] = part, mark[at : at + length]
    return ids, tags


# ---------------------------------------------------------------- the model


@dataclass
class Tagger:
    """embed (vocabulary, EMBED); weights of each direction d: inputs[d] (EMBED, 4 H), loops[d] (H, 4 H), outs[d] (H, tags); bias and trans of the CRF.

    Gates lie in the order input, forget, output, candidate; those of sigmoid are stored as halves, as s(x) = (1 + tanh(x / 2)) / 2."""

    embed: np.ndarray
    inputs: np.ndarray
    loops: np.ndarray
    outs: np.ndarray
    bias: np.ndarray
    trans: np.ndarray

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(T, tags, B) of ids (B, T), in float32. Padding is at the ends of rows, of which the shorter come first; it keeps the state at zero."""
        b, t = ids.shape
        full = np.count_nonzero(ids, axis=1)
        # at column k the first short[k] rows are padding
        short = np.searchsorted(full, np.arange(t), side="right")
        h = self.loops.shape[1]
        out = np.empty((t, TAGS, b), np.float32)
        columns, embed = np.ascontiguousarray(ids.T), np.ascontiguousarray(self.embed.T)
        e, bias = len(embed), self.bias[:, None]
        gates = np.empty((4 * h, b), np.float32)
        for d in range(2):
            # the state is kept doubled, which saves halving the output gate; the weights that it meets are halved instead
            both, project = np.ascontiguousarray(np.concatenate([self.inputs[d], self.loops[d] / 2]).T), np.ascontiguousarray(self.outs[d].T / 2)
            # the character's vector and the state, one above the other
            joined, cell = np.zeros((e + h, b), np.float32), np.zeros((h, b), np.float32)
            vector, state = joined[:e], joined[e:]
            one, emit = np.empty((h, b), np.float32), np.empty((TAGS, b), np.float32)
            for k in range(t) if d == 0 else range(t - 1, -1, -1):
                np.take(embed, columns[k], axis=1, out=vector, mode="clip")
                np.matmul(both, joined, out=gates)
                np.tanh(gates, out=gates)
                # twice the gates; the cell is halved once for both of its terms
                gates[: 3 * h] += 1
                np.multiply(gates[:h], gates[3 * h :], out=one)
                cell *= gates[h : 2 * h]
                cell += one
                cell *= 0.5
                np.tanh(cell, out=one)
                np.multiply(gates[2 * h : 3 * h], one, out=state)
                if d and short[k]:
                    state[:, : short[k]] = 0
                    cell[:, : short[k]] = 0
                if d:
                    np.matmul(project, state, out=emit)
                    out[k] += emit
                else:
                    np.matmul(project, state, out=out[k])
                    out[k] += bias
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """(B, T) best tags of rows, each searched in whole."""
        order = np.argsort(np.count_nonzero(ids, axis=1), kind="stable")
        tags = np.empty(ids.shape, np.uint8)
        tags[order] = self._viterbi(self.emissions(ids[order]))
        return tags

    def islands(self, lead: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last + 1) of the stretches in which the best tags may be other than none. Documents lie side by side and begin at begin; lead is at most the score of none less the best of the others.

        A run of tags from i to j, none before and after it, gains at most enter[i] - sum(lead[i..j]) + (j - i) * inside + leave[j] against none at all, where transitions into, within and out of it count at their
        best, and those at a document's ends not at all. The best such bound over all runs across k is the best start up to k and the best end from k on, in sums from the document's begin: two running maxima."""
        n, t00 = len(lead), self.trans[0, 0]
        into, inside, out = float((self.trans[0, 1:] - t00).max()), float((self.trans[1:, 1:] - t00).max()), float((self.trans[1:, 0] - t00).max())
        starts = np.zeros(n, bool)
        starts[begin] = True
        ends = np.append(starts[1:], True)
        size = np.diff(np.append(begin, n))
        step = inside - lead.astype(np.float64)
        upto = np.cumsum(step)
        upto -= np.repeat(upto[begin] - step[begin], size)
        start = np.where(starts, 0.0, into) - (upto - step)
        end = upto + np.where(ends, 0.0, out)
        # a wall between documents, higher than any difference
        wall = np.repeat(np.arange(len(begin)) * (float(max(np.ptp(start), np.ptp(end))) + 1), size)
        start += wall
        end -= wall
        bound = np.maximum.accumulate(start, out=start)
        bound += np.maximum.accumulate(end[::-1], out=end[::-1])[::-1]
        some = bound > inside - 1e-2
        first = np.flatnonzero(some & (starts | ~np.append(False, some[:-1])))
        last = np.flatnonzero(some & (ends | ~np.append(some[1:], False)))
        return first, last + 1

    def best_tags(self, lead: np.ndarray, begin: np.ndarray, scores) -> np.ndarray:
        """The best tags of documents side by side; scores(places) gives the scores (tags, ...) there."""
        n = len(lead)
        tags = np.zeros(n, np.uint8)
        first, last = self.islands(lead, begin)
        size = last - first
        order = np.argsort(size, kind="stable")
        opens, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        opens[begin], ends[np.append(begin[1:], n)] = True, True
        lo = 0
        while lo < len(order):
            least = int(size[order[lo]])
            hi = min(int(np.searchsorted(size[order], 1.25 * least + 4, side="right")), lo + max(16, BATCH_CHARS // (2 * least + 8)))
            pick = order[lo:hi]
            # the columns beyond an island have no tag, and one at least is there to leave to
            width = int(size[pick].max()) + 1
            at = first[pick, None] + np.arange(width)
            rest = np.arange(width) >= size[pick, None]
            score = scores(np.where(rest, first[pick, None], at))
            score[1:, rest] = -1e9
            score[0, rest] = 0
            score[:, :, 0] += np.where(opens[first[pick]], 0, self.trans[0][:, None])
            closed = np.flatnonzero(ends[last[pick]])
            score[:, closed, size[pick[closed]] - 1] -= self.trans[:, :1]
            got = self._viterbi(np.ascontiguousarray(score.transpose(2, 0, 1)))
            tags[at[~rest]] = got[~rest]
            lo = hi
        return tags

    def _viterbi(self, score: np.ndarray) -> np.ndarray:
        t, _, b = score.shape
        best, moved = np.empty((TAGS, b), np.float32), np.empty((TAGS, b), np.float32)
        # whether the best way to "none" comes from "none"
        calm = np.empty((t, b), bool)
        for k in range(1, t):
            before, now = score[k - 1], score[k]
            for y in range(TAGS):
                np.add(before, self.trans[:, y : y + 1], out=moved)
                moved.max(axis=0, out=best[y])
                if y == 0:
                    np.equal(moved[0], best[0], out=calm[k])
            now += best
        tags = np.zeros((t, b), np.uint8)
        tags[-1] = score[-1].argmax(axis=0)
        for k in range(t - 2, -1, -1):
            nxt = tags[k + 1]
            some = np.flatnonzero((nxt != 0) | ~calm[k + 1])
            if len(some):
                tags[k, some] = (score[k][:, some] + self.trans[:, nxt[some]]).argmax(axis=0)
        return tags.T


def _lstm(ids, tables, loops):
    """Forward pass of both directions side by side, which keeps what backpropagation needs. ids (2, B, T) in each direction's order; arrays (T, 2, B, .)."""
    _, b, t = ids.shape
    h = loops.shape[1]
    given = np.ascontiguousarray(np.stack([tables[d][ids[d]] for d in range(2)]).transpose(2, 0, 1, 3))
    there = np.ascontiguousarray((ids != PAD).astype(np.float32).transpose(2, 0, 1))[..., None]
    act, cells, states = np.empty((t, 2, b, 4 * h), np.float32), np.zeros((t + 1, 2, b, h), np.float32), np.zeros((t + 1, 2, b, h), np.float32)
    tanhs = np.empty((t, 2, b, h), np.float32)
    for s in range(t):
        a = act[s]
        np.matmul(states[s], loops, out=a)
        a += given[s]
        np.tanh(a, out=a)
        a[..., : 3 * h] += 1
        a[..., : 3 * h] *= 0.5
        cells[s + 1] = (a[..., h : 2 * h] * cells[s] + a[..., :h] * a[..., 3 * h :]) * there[s]
        np.tanh(cells[s + 1], out=tanhs[s])
        np.multiply(a[..., 2 * h : 3 * h], tanhs[s], out=states[s + 1])
    return act, cells, states, tanhs, there


def _lstm_back(ids, loops, kept, dstates):
    """Gradients of the tables and the loops, from those of the states (T, 2, B, h)."""
    act, cells, states, tanhs, there = kept
    t, _, b, h4 = act.shape
    h = h4 // 4
    dg_all = np.empty((t, 2, b, h4), np.float32)
    i, f, o, c = (act[..., k * h : (k + 1) * h] for k in range(4))
    # halves: the derivative of s(x) = (1 + tanh(g)) / 2 by g is 2 s (1 - s)
    by_i, by_f, by_o, by_c = c * 2 * i * (1 - i), cells[:-1] * 2 * f * (1 - f), tanhs * 2 * o * (1 - o), i * (1 - c * c)
    through = o * (1 - tanhs * tanhs)
    dh, dc = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
    back = np.ascontiguousarray(loops.transpose(0, 2, 1))
    for s in range(t - 1, -1, -1):
        dh += dstates[s]
        dh *= there[s]
        dc *= there[s]
        dc += dh * through[s]
        dg = dg_all[s]
        np.multiply(dc, by_i[s], out=dg[..., :h])
        np.multiply(dc, by_f[s], out=dg[..., h : 2 * h])
        np.multiply(dh, by_o[s], out=dg[..., 2 * h : 3 * h])
        np.multiply(dc, by_c[s], out=dg[..., 3 * h :])
        dh = dg @ back
        dc *= f[s]
    # products of small matrices, summed: one large product would wake the library's threads for little
    dloops = (states[:-1].transpose(0, 1, 3, 2) @ dg_all).sum(axis=0)
    tables = np.zeros((2, VOCABULARY, h4), np.float32)
    for d in range(2):
        seen = ids[d].T.reshape(-1)
        by_char = np.argsort(seen, kind="stable")
        begin = np.flatnonzero(np.diff(seen[by_char].astype(np.int64), prepend=-1))
        tables[d, seen[by_char[begin]]] = np.add.reduceat(dg_all[:, d].reshape(-1, h4)[by_char], begin)
    return tables, dloops


def _crf(score, tags, trans):
    """Mean negative log likelihood and its gradients; score (T, B, tags)."""
    t, b, n = score.shape
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[0] = score[0]
    # sums over the tag before and over the tag after, side by side
    steps = np.exp(np.stack([trans, trans.T]))
    for k in range(1, t):
        x = np.stack([alpha[k - 1], beta[t - k] + score[t - k]])
        top = x.max(axis=2, keepdims=True)
        y = np.log(np.exp(x - top) @ steps) + top
        alpha[k], beta[t - 1 - k] = score[k] + y[0], y[1]
    top = alpha[-1].max(axis=1)
    z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(axis=1))
    p = np.exp(alpha + beta - z[None, :, None])
    rows = np.arange(b)
    gold = sum(score[k, rows, tags[:, k]] for k in range(t)) + sum(trans[tags[:, k - 1], tags[:, k]] for k in range(1, t))
    dscore = p.copy()
    for k in range(t):
        dscore[k, rows, tags[:, k]] -= 1
    both = np.exp(alpha[:-1, :, :, None] + trans[None, None] + (score[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None])
    dtrans = both.sum(axis=(0, 1))
    np.subtract.at(dtrans, (tags[:, :-1].reshape(-1), tags[:, 1:].reshape(-1)), 1)
    return (z - gold).mean(), dscore / b, dtrans / b


def windows_of(labelled: Sequence[tuple[str, Sequence[tuple[int, int, str]]]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tags) in rows of `length` characters of texts with their spans (begin, end, kind)."""
    ids, tags = [], []
    for text, found in labelled:
        x, y = char_ids(text), np.zeros(len(text), np.uint8)
        for a, e, kind in found:
            y[a:e] = KINDS.index(kind) + 1
        for k in range(0, len(x), length):
            ids.append(np.pad(x[k : k + length], (0, max(0, k + length - len(x)))))
            tags.append(np.pad(y[k : k + length], (0, max(0, k + length - len(x)))))
    return np.array(ids, np.uint8), np.array(tags, np.uint8)


def train(steps: int = TRAIN_STEPS, seed: int = SEED, hidden: int = HIDDEN, batch: int = TRAIN_BATCH, length: int = TRAIN_LENGTH, pool: int = 80, labelled: Sequence[tuple[str, Sequence[tuple[int, int, str]]]] | None = None) -> Tagger:
    """Fits the tagger to labelled texts, or to composed ones; the latter, a pool of them, are drawn once. Random batches go through either."""
    rng = np.random.default_rng(seed)
    ids_all, tags_all = windows_of(labelled, length) if labelled else training_texts(Dice(seed), pool * batch, length)
    w = {"e": rng.normal(size=(VOCABULARY, EMBED)) * 0.5} | {f"x{d}": rng.normal(size=(EMBED, 4 * hidden)) * 0.4 for d in range(2)} | {f"l{d}": rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden) / 2 for d in range(2)} | {f"o{d}": rng.normal(size=(hidden, TAGS)) * 0.3 for d in range(2)} | {"b": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}
    w = {k: x.astype(np.float32) for k, x in w.items()}
    w["e"][:, 0] = 1
    for d in range(2):
        w[f"x{d}"][0, hidden : 2 * hidden] += 0.7
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(ids_all), batch)
        ids, tags = ids_all[pick], tags_all[pick]
        both, loops = np.stack([ids, ids[:, ::-1]]), np.stack([w["l0"], w["l1"]])
        kept = _lstm(both, [w["e"] @ w[f"x{d}"] for d in range(2)], loops)
        states = kept[2][1:]
        score = w["b"] + states[:, 0] @ w["o0"] + (states[:, 1] @ w["o1"])[::-1]
        _, ds, dt = _crf(score, tags, w["t"])
        g = {"t": dt, "b": ds.sum(axis=(0, 1)), "e": np.zeros_like(w["e"])}
        own = [ds, ds[::-1]]
        tables, dloops = _lstm_back(both, loops, kept, np.stack([own[d] @ w[f"o{d}"].T for d in range(2)], axis=1))
        for d in range(2):
            g[f"o{d}"] = (states[:, d].transpose(0, 2, 1) @ own[d]).sum(axis=0)
            g[f"l{d}"] = dloops[d]
            g[f"x{d}"] = w["e"].T @ tables[d]
            g["e"] += tables[d] @ w[f"x{d}"].T
        norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
        rate = 0.02 * min(1, step / 20) * (0.02 + 0.98 * 0.5 * (1 + np.cos(np.pi * step / steps)))
        for k, x in g.items():
            x *= min(1, 10 / norm)
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.01 * (x * x - v[k])
            w[k] -= rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    f = np.float32
    return Tagger(w["e"].astype(f), np.stack([w["x0"], w["x1"]]).astype(f), np.stack([w["l0"], w["l1"]]).astype(f), np.stack([w["o0"], w["o1"]]).astype(f), w["b"].astype(f), w["t"].astype(f))


#: Part of a kept model's name; changes with what training does.
VERSION = 2


def to_bytes(model: Tagger) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, **vars(model))
    return out.getvalue()


def from_bytes(raw: bytes) -> Tagger:
    import io

    return Tagger(**np.load(io.BytesIO(raw), allow_pickle=False))


def default_tagger(spark: SparkSession | None = None) -> Tagger:
    """The tagger of the default training, made once: kept in the process and, where a session is given, in its shared folder."""
    cache = process_cache()
    if "tagger" in cache:
        return cache["tagger"]
    if spark is None:
        cache["tagger"] = train()
        return cache["tagger"]
    path = f"{shared_dir(spark)}/tagger-{VERSION}-{SEED}-{TRAIN_STEPS}-{HIDDEN}-{EMBED}-{TRAIN_BATCH}-{TRAIN_LENGTH}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        # written aside and renamed: what is there is whole, and who comes second leaves it
        aside = f"{path}-{uuid.uuid4().hex}"
        spark.createDataFrame([(bytearray(to_bytes(train())),)], "model binary").coalesce(1).write.parquet(aside)
        if fs.exists(at) or not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), at):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)
    cache["tagger"] = from_bytes(bytes(spark.read.schema("model binary").parquet(path).first()[0]))
    return cache["tagger"]


# ---------------------------------------------------------------- whole documents


def tag_documents(model: Tagger, rows: list[np.ndarray], window: int = WINDOW, overlap: int = OVERLAP) -> list[np.ndarray]:
    """Tags of each row of character ids, however long. Windows of similar length share a batch."""
    rows_all, rows = rows, [x for x in rows if len(x)]
    if not rows:
        return [np.zeros(0, np.uint8) for _ in rows_all]
    stride = window - overlap
    size = np.array([len(x) for x in rows])
    begin = np.cumsum(size) - size
    n = np.maximum(1, -(-(size - overlap) // stride))
    owner = np.repeat(np.arange(len(rows)), n)
    first_window = np.cumsum(n) - n
    place = np.arange(len(owner)) - first_window[owner]
    starts = place * stride
    length = np.minimum(window, size[owner] - starts)
    flat = np.concatenate([*rows, np.zeros(window, np.uint8)])
    base = begin[owner] + starts
    order = np.argsort(length, kind="stable")
    # the share that a window's scores have in the overlap with the next one falls from 1 to 0
    fall = (1 - (np.arange(overlap) + 0.5) / overlap).astype(np.float32)
    lead = np.zeros(int(size.sum()), np.float32)
    batch_of, column_of, kept = np.empty(len(owner), np.int32), np.empty(len(owner), np.int32), []
    lo = 0
    while lo < len(order):
        # as many windows as fit, and none that would be more than a quarter padding
        width = max(8, int(length[order[lo]]))
        most = int(np.searchsorted(length[order], 1.25 * width + 8, side="right"))
        hi = min(most, lo + max(64, BATCH_CHARS // max(8, int(1.25 * width + 8))))
        pick = order[lo:hi]
        width = int(length[pick].max())
        ids = flat[base[pick, None] + np.arange(width)]
        there = np.arange(width) < length[pick, None]
        ids[~there] = PAD
        score = model.emissions(ids)
        batch_of[pick], column_of[pick] = len(kept), np.arange(len(pick))
        kept.append(score)
        ahead = np.ascontiguousarray((score[:, 0] - score[:, 1:].max(axis=1)).T)
        inner, followed = place[pick] > 0, place[pick] + 1 < n[owner[pick]]
        if inner.any():
            ahead[inner, :overlap] *= fall[::-1]
        if followed.any():
            ahead[followed, stride:window] *= fall
        # every other window of a document, and then the rest: no two of either overlap
        for odd in (0, 1):
            some = np.flatnonzero(place[pick] % 2 == odd)
            if len(some):
                at = base[pick[some], None] + np.arange(width)
                lead[at[there[some]]] += ahead[some][there[some]]
        lo = hi

    def scores(at: np.ndarray) -> np.ndarray:
        shape, at = at.shape, at.reshape(-1)
        doc = np.searchsorted(begin, at, side="right") - 1
        inside = at - begin[doc]
        k = np.minimum(inside // stride, n[doc] - 1)
        t = inside - k * stride
        out = np.empty((TAGS, len(at)), np.float32)

        def take(some: np.ndarray, w: np.ndarray, t: np.ndarray) -> np.ndarray:
            got = np.empty((len(some), TAGS), np.float32)
            batch = batch_of[w]
            for b in np.unique(batch):
                mine = batch == b
                got[mine] = kept[b][t[mine], :, column_of[w[mine]]]
            return got.T

        w = first_window[doc] + k
        out[:] = take(at, w, t)
        both = np.flatnonzero((k > 0) & (t < overlap))
        if len(both):
            share = fall[t[both]]
            out[:, both] = out[:, both] * (1 - share) + take(at[both], w[both] - 1, t[both] + stride) * share
        return out.reshape(TAGS, *shape)

    tags = model.best_tags(lead, begin, scores)
    found = iter(np.split(tags, begin[1:]))
    return [next(found) if len(x) else np.zeros(0, np.uint8) for x in rows_all]


def spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, end, kind) of the runs of one tag other than none."""
    if not len(tags):
        return []
    edge = np.flatnonzero(np.append(True, tags[1:] != tags[:-1]))
    ends = np.append(edge[1:], len(tags))
    return [(int(a), int(b), int(tags[a]) - 1) for a, b in zip(edge, ends, strict=True) if tags[a]]


def plausible(found: list[tuple[int, int, int]], text: str) -> list[tuple[int, int, int]]:
    """The spans that have what their kind can't be without: an address its @, an IP three separators, the others their number of digits or characters."""
    out = []
    for a, b, kind in found:
        s = text[a:b]
        digits = sum(c.isdigit() for c in s)
        name = KINDS[kind]
        if name == "EMAIL" and ("@" not in s.strip("@") or "." not in s) or name == "IP" and (s.count(".") != 3 or digits < 4) or name == "PHONE" and digits < 7 or name == "CARD" and digits < 13 or name == "ID" and digits != 9 or name == "SECRET" and (len(s) < 16 or digits == 0):
            continue
        out.append((a, b, kind))
    return out


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for a, b, kind in found:
        parts += [text[at:a], f"<{KINDS[kind]}>"]
        at = b
    return "".join(parts) + text[at:]


_SPAN = pa.struct([("span_begin", pa.int32()), ("span_end", pa.int32()), ("kind", pa.string()), ("found", pa.string())])


def _finder(model: Tagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            lo = chars = 0
            for hi, t in enumerate(texts, 1):
                chars += len(t)
                if chars < 2 << 20 and hi < len(texts):
                    continue
                some = texts[lo:hi]
                found = [plausible(spans(x), t) for x, t in zip(tag_documents(model, [char_ids(x) for x in some]), some, strict=True)]
                hit = [k for k, x in enumerate(found) if x]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).take(pa.array(hit, pa.int64())),
                        pa.array([[{"span_begin": a, "span_end": e, "kind": KINDS[k], "found": some[j][a:e]} for a, e, k in found[j]] for j in hit], pa.list_(_SPAN)),
                        pa.array([redact(some[j], found[j]) for j in hit], pa.string()),
                    ],
                    names=["doc_id", "spans", "redacted"],
                )
                lo, chars = hi, 0

    return run


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """(doc_id, spans, redacted) of every document that has personal data: its spans in order, and the text with each replaced by its kind."""
    model = model or default_tagger(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(_finder(model), f"doc_id {kind}, spans array<struct<span_begin:int,span_end:int,kind:string,found:string>>, redacted string")
