"""Secret scans by grammar inference.

From labelled credentials of each published format a stochastic automaton is inferred by state merging (ALERGIA): the strings
form a prefix tree with counts, and two states are merged where the frequencies of ending and of each next
symbol, in them and in all that follows, agree within the Hoeffding bound of confidence ALPHA. Lengths, which
merging into loops forgets, are modelled beside it by their own smoothed frequencies.

Every candidate of a text is scored by every automaton, whatever its length: mean bits a symbol, against a background automaton inferred from
labelled strings that are no credentials. Candidates are the runs of MIN_LENGTH or more credential symbols and, within a run,
all spans of as many between any two BOUNDARY symbols, whatever the number of pieces between them. Those of up to SPAN pieces and of a format's own lengths are
written out; of longer ones only those are walked, from their start on, for which bounds leave it open whether they are findings. A finding is a candidate that is
about as likely under a format as held-out credentials of that format are, and is likelier by it than by the background by
MARGIN bits a symbol, with the bits that its length costs. A span within a run must also have a head of HEAD symbols that the
format's strings have or, in a format without fixed heads, be about as likely as under a code of equal lengths for all symbols.

Some formats (`hex_key`, `upper_hex_key`, `cloud_secret_40`) are nothing but one alphabet and certain lengths: their automata have a single state, and digests and
encoded data fit them as well. A finding that an automaton of such strings explains as well but for ALIKE bits is reported in the format's own lengths, but not after a word
like "commit" or "sha256", and in other lengths only after one like "token"; automata inferred from labelled words tell which these are.

A finding of a length that its format hasn't gives way to any other that it overlaps. A finding within another of its format is dropped; of others that overlap,
those are kept that save the most bits in sum over the background. numpy walks all candidates of a batch through all automata at once.

The labelled strings are generated from the published formats by a fixed seed (`labelled`); `fit` takes any
others.

A format whose strings have few beginnings has an automaton for these and one for the rest. A format of parts without a fixed length (PARTS) has an automaton for each part, one after the other; its strings are of any length
from the least of the labelled ones.

Defined results: null and empty texts have no findings; a text of any length is scanned whole; repeated rows and repeated candidates are each reported; a null
doc_id passes through; on a tie of formats the first by name is taken, of findings that save the same the earlier one; credentials glued to a letter or digit before
or after them are no candidates; empty tables give empty results; further columns, also of names that differ by case only, are ignored.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact, load

MIN_LENGTH, ALPHA, MARGIN, SLACK, FLOOR = 16, 0.05, 0.5, 0.35, -14.0
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.\-]{%d,}={0,2}" % MIN_LENGTH)
PARTS = {"json_web_token": "."}  # formats of several parts, each of any length, and what stands between the parts
SIGNATURES = (43,) * 6 + (64, 86, 86, 128, 176, 342)  # base64url symbols of the published algorithms' signatures
CELLS, LANES = 1 << 22, 1 << 12
EQUAL, HEAD, SPAN = math.log2(67), 4, 8
UNSEEN, CONTEXT, ALIKE = 0.002, 6.0, 2.0
UNSEEN_BITS = math.log2(UNSEEN) - math.log2(MIN_LENGTH + 1)  # the most that SeenLengths gives a length that it hasn't seen
#: Words that stand before credentials, and before digests and other names of content.
CREDENTIAL_WORDS = "token tokens secret secrets key keys apikey password passwd pwd passphrase auth authorization bearer credential credentials access private client api jwt login signing".split()
DIGEST_WORDS = "commit commits sha sha1 sha224 sha256 sha384 sha512 md4 md5 checksum checksums digest digests hash hashes etag revision rev tree blob parent object merge merged fingerprint integrity uuid guid build version release crc changeset".split()
BOUNDARY = re.compile(r"[./_+\-]")
_WORDS = re.compile(r"[a-z0-9]+")
HEX, UPPER_HEX, ALNUM, B64 = "0123456789abcdef", "0123456789ABCDEF", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"


def labelled(seed: int = 7, each: int = 400) -> dict[str, list[str]]:
    """Credentials by format, strings that are none under the name "background", and digests and encoded data under names that begin with "content"."""
    rng = random.Random(seed)
    r = lambda symbols, n: "".join(rng.choices(symbols, k=n))
    b64url = ALNUM + "-_"
    # an object in base64url: {" in most, else a brace before a space, a line feed or a carriage return
    json = lambda least, most: rng.choice(("eyJ",) * 7 + ("eyA", "ewo", "ew0")) + r(b64url, rng.randint(least, most))
    makers = {
        "access_key_id": lambda: rng.choice(("AKIA", "ASIA")) + r(string.ascii_uppercase + "234567", 16),
        "cloud_secret_40": lambda: r(B64, 40),
        "git_host_token": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + r(ALNUM, 36),
        "git_lab_token": lambda: "glpat-" + r(b64url, 20),
        "chat_token": lambda: f"xox{rng.choice('bp')}-{r(string.digits, 12)}-{r(string.digits, 12)}-{r(ALNUM, 24)}",
        "maps_api_key": lambda: "AIza" + r(b64url, 35),
        "payment_key": lambda: rng.choice(("sk_live_", "rk_live_", "sk_test_")) + r(ALNUM, 24),
        "package_token": lambda: "npm_" + r(ALNUM, 36),
        "json_web_token": lambda: ".".join((json(17, 60), json(7, 60), r(b64url, rng.choice(SIGNATURES)))),
        "hex_key": lambda: r(HEX, rng.choice((32, 40, 64))),
        "upper_hex_key": lambda: r(UPPER_HEX, rng.choice((32, 40, 64))),
    }
    syllables = [a + b for a in "b c d f g h l m n p r s t th st".split() for b in "a e i o u er an in on".split()]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    others = (
        lambda: r(string.digits, rng.randint(16, 20)),
        lambda: f"{word()}{word()}{word()}{word()}{rng.randint(0, 99)}",
        lambda: "_".join(word() for _ in range(4)) + str(rng.randint(0, 9)),
        lambda: f"{word()}/{word()}/{word()}/{word()}{rng.randint(0, 999)}.html",
        lambda: f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}.{rng.randint(10, 59)}",
        lambda: f"{word()}.{word()}.{word()}{rng.randint(0, 9)}.com",
        lambda: f"{word().capitalize()}-{word()}-{word()}-{rng.randint(100, 9999)}",
        lambda: f"{rng.randint(1, 99)}.{rng.randint(0, 99)}.{rng.randint(0, 999)}-{word()}{rng.randint(1, 9)}-{word()}",
        lambda: "-".join(r(HEX, n) for n in (8, 4, 4, 4, 12)),
        lambda: f"{word().upper()}{word().upper()}{word().upper()}{rng.randint(0, 9999)}",
    )
    out = {k: [f() for _ in range(each * (5 if k in PARTS else 1))] for k, f in makers.items()}  # more of those without a fixed length
    content = {k: [r(symbols, rng.randint(16, 200)) for _ in range(each)] for k, symbols in (("hex", HEX), ("upper", UPPER_HEX), ("base64", B64), ("base64url", b64url))}
    return out | {"background": [f() for f in others for _ in range(each)]} | {f"content_{k}": v for k, v in content.items()}


class Automaton:
    """A stochastic automaton: next[state, symbol] and log2 probabilities; symbols are bytes.

    A symbol that a state hasn't seen costs FLOOR bits, and after it the string is outside the language. Without `leave` it costs that only where no state has
    seen it, and the string goes on where the state's likeliest symbol leads.
    """

    def __init__(self, samples: list[str], alpha: float = ALPHA, leave: bool = True):
        if not samples:
            raise ValueError("an automaton needs samples")
        children, ends, passes = [{}], [0], [0]
        for s in samples:
            at = 0
            passes[0] += 1
            for c in s.encode():
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    ends.append(0)
                    passes.append(0)
                at = nxt
                passes[at] += 1
            ends[at] += 1
        self._c, self._e = children, ends
        self._n = {q: {c: passes[x] for c, x in kids.items()} for q, kids in enumerate(children)}
        self._p = passes
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self._table(leave)

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self._bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if a == b or not self._p[a] or not self._p[b]:
                continue
            if self._differ(self._e[a], self._p[a], self._e[b], self._p[b]):
                return False
            for c in self._n[a].keys() | self._n[b].keys():
                if self._differ(self._n[a].get(c, 0), self._p[a], self._n[b].get(c, 0), self._p[b]):
                    return False
                if c in self._c[a] and c in self._c[b]:
                    stack.append((self._c[a][c], self._c[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b into a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self._e[a] += self._e[b]
            self._p[a] += self._p[b]
            for c, n in self._n[b].items():
                self._n[a][c] = self._n[a].get(c, 0) + n
                if c in self._c[a]:
                    stack.append((self._c[a][c], self._c[b][c]))
                else:
                    self._c[a][c] = self._c[b][c]

    def _merge_all(self) -> None:
        red, seen = [0], {0}
        blue = [(0, c) for c in sorted(self._c[0])]
        while blue:
            blue.sort(key=lambda x: -self._p[self._c[x[0]][x[1]]])
            source, c = blue.pop(0)
            q = self._c[source][c]
            if q in seen:
                continue
            for r in red:
                if self._compatible(r, q):
                    self._c[source][c] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
                seen.add(q)
            blue = [(r, c) for r in red for c, x in sorted(self._c[r].items()) if x not in seen]
        self.states = red

    def _table(self, leave: bool) -> None:
        number = {q: k for k, q in enumerate(self.states)}
        symbols = sorted({c for q in self.states for c in self._n[q]})
        alphabet = len(symbols)
        self.next = np.full((len(self.states) + 1, 256), len(self.states), np.int32)  # the last state: outside the language
        self.log = np.full((len(self.states) + 1, 256), FLOOR, np.float32)
        for q, k in number.items():
            prior = 0.02 if leave else 0.5
            total = sum(self._n[q].values()) + self._e[q] + prior * alphabet
            if not leave:
                self.next[k] = number[self._c[q][max(sorted(self._n[q]), key=self._n[q].get)]] if self._n[q] else k
                self.log[k, symbols] = math.log2(prior / total)
            for c, n in self._n[q].items():
                self.next[k, c] = number[self._c[q][c]]
                self.log[k, c] = math.log2((n + prior) / total)
        self.end = np.zeros(len(self.next))  # added where a string ends: 0, or -inf where it can't
        del self._c, self._e, self._n, self._p

    def bits(self, text: str) -> float:
        """Mean log2 probability of a symbol, walked one by one."""
        q, total = 0, 0.0
        for c in text.encode():
            total += float(self.log[q, c])
            q = self.next[q, c]
        return (total + float(self.end[q])) / max(1, len(text))


class Chain(Automaton):
    """Automata of a format's parts one after the other, each inferred from its own part; a string must end in the last one.

    Where the strings of a part have few different beginnings, these are a piece of their own, so that merging can't mix them
    with what follows. ALPHA is shared among the symbols that one merge compares. Without a separator a string is one part, of which a rare symbol that wasn't seen
    in a place costs bits but isn't outside.
    """

    def __init__(self, samples: list[str], separator: str | None, alpha: float = ALPHA):
        pieces: list[tuple[Automaton, float | None]] = []  # with the mean length of a piece that a separator ends
        for part in zip(*(x.split(separator) for x in samples)):
            few = len({x[:3] for x in part}) <= 8
            alphabet = len(set("".join(part)))
            if few:
                pieces.append((Automaton([x[:3] for x in part], alpha / alphabet), None))
            pieces.append((Automaton([x[3 * few :] for x in part], alpha / alphabet, leave=separator is not None), sum(map(len, part)) / len(part)))
        first = np.cumsum([0] + [len(m.next) - 1 for m, _ in pieces])  # the pieces' states, then one outside
        out = int(first[-1])
        self.next, self.log = np.full((out + 1, 256), out, np.int32), np.full((out + 1, 256), FLOOR, np.float32)
        self.end = np.full(out + 1, -np.inf)
        for k, (m, mean) in enumerate(pieces):
            n, own = len(m.next) - 1, slice(first[k], first[k + 1])
            to = m.next[:n] + first[k]
            if mean is None:  # states without a way on are the start of the next piece
                to[(m.next == n).all(1)[m.next[:n]]] = first[k + 1]
            self.next[own], self.log[own] = np.where(m.next[:n] == n, out, to), m.log[:n]
            if k + 1 == len(pieces):
                self.end[own] = 0.0
            elif mean is not None:
                self.next[own, ord(separator)], self.log[own, ord(separator)] = first[k + 1], -math.log2(mean)
        self.states = list(range(out))


class AnyLength:
    """log2 frequencies of lengths, of `least` or more without an end: least / n / (n + 1)."""

    def __init__(self, least: int):
        self.least = least

    def __contains__(self, n: int) -> bool:
        return n >= self.least

    def __getitem__(self, n: int) -> float:
        return math.log2(self.least) - math.log2(n) - math.log2(n + 1) if n >= self.least else -math.inf


class SeenLengths:
    """Smoothed log2 frequencies of lengths: of those seen, and for UNSEEN in all of every other one, the longer the less."""

    def __init__(self, samples: list[str]):
        counts = Counter(map(len, samples))
        total = sum(counts.values())
        self.seen = {n: math.log2((1 - UNSEEN) * c / total) for n, c in counts.items() if c / total >= UNSEEN}

    def __contains__(self, n: int) -> bool:
        return n in self.seen

    def __getitem__(self, n: int) -> float:
        return self.seen.get(n) or math.log2(UNSEEN * MIN_LENGTH) - math.log2(max(n, MIN_LENGTH)) - math.log2(max(n, MIN_LENGTH) + 1)


class Context:
    """What kind of word stands before a place, by automata inferred from labelled words of each kind."""

    def __init__(self, credential: list[str], content: list[str], other: list[str]):
        self.longest = max(map(len, credential + content))
        self.machines = [Automaton([f"{w}$" for w in words for _ in range(20)]) for words in (credential, content)] + [Automaton([f"{w[: self.longest]}$" for w in other], leave=False)]
        self.kind = lru_cache(maxsize=4096)(self._kind)

    def __getstate__(self) -> dict:
        return {"machines": self.machines, "longest": self.longest}

    def __setstate__(self, state: dict) -> None:
        self.machines, self.longest = state["machines"], state["longest"]
        self.kind = lru_cache(maxsize=4096)(self._kind)

    def _kind(self, word: str) -> str:
        credential, content, other = (m.bits(f"{word}$") * (len(word) + 1) for m in self.machines)
        if credential - max(content, other) >= CONTEXT:
            return "credential"
        return "content" if content - max(credential, other) >= CONTEXT else ""

    def before(self, text: str, start: int) -> str:
        """"credential" or "content" by the last four words before start, or ""; the nearest that is either tells."""
        words = _WORDS.findall(text[max(0, start - 48) : start].lower())[-4:]
        kinds = [k for w in reversed(words) if len(w) <= self.longest and (k := self.kind(w))][:1]
        return "credential" if "credential" in kinds else "content" if "content" in kinds else ""


class Walker:
    """Several automata as one table, walked side by side."""

    def __init__(self, machines: list[Automaton]):
        first = np.cumsum([0, *(len(m.next) for m in machines)])
        self.start = first[:-1].astype(np.int32)
        self.next = np.concatenate([m.next + a for m, a in zip(machines, first)]).astype(np.int32)
        self.log, self.end = np.concatenate([m.log for m in machines]), np.concatenate([m.end for m in machines])

    def bits(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(rows, automata): mean log2 probability of a symbol, of the rows of a zero-padded matrix of symbols, sorted by falling length."""
        total, q = self.walk(symbols, lengths)
        return (total + self.end[q]) / np.maximum(lengths, 1)[:, None]

    def walk(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, automata): the sums of log2 probabilities, and the last states."""
        q, total = np.tile(self.start, (len(symbols), 1)), np.zeros((len(symbols), len(self.start)))
        left = np.searchsorted(-lengths, -np.arange(symbols.shape[1]), side="left") if len(symbols) else []
        for j, n in enumerate(left):
            s, c = q[:n], symbols[:n, j, None]
            total[:n] += self.log[s, c]
            q[:n] = self.next[s, c]
        return total, q

    def spans(self, symbols: np.ndarray, begin: np.ndarray, first: np.ndarray, last: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(starts, lengths, bits as above) of the spans from each start to every stop from its first to its last, in groups; each start is walked once."""
        order = np.argsort(begin - last, kind="stable")
        for group in np.split(order, range(LANES, len(order), LANES)):
            a, least, n = begin[group], first[group], (last - begin)[group]
            q, total = np.tile(self.start, (len(a), 1)), np.zeros((len(a), len(self.start)))
            found, rows = [], 0
            for t in range(int(n.max(initial=0))):
                live = int(np.searchsorted(-n, -t, side="left"))
                s, c = q[:live], symbols[a[:live] + t, None]
                total[:live] += self.log[s, c]
                q[:live] = self.next[s, c]
                ends = a[:live] + t + 1
                hit = np.flatnonzero(stop[ends] & (ends >= least[:live]))
                if len(hit):
                    found.append((a[hit], np.full(len(hit), t + 1), (total[hit] + self.end[q[hit]]) / (t + 1)))
                    rows += len(hit)
                if found and (rows >= LANES or t + 1 == n[0]):
                    yield tuple(map(np.concatenate, zip(*found)))
                    found, rows = [], 0


class Scanner:
    def __init__(self, samples: dict[str, list[str]], margin: float = MARGIN):
        """A fifth of each format's strings is held out and sets the format's threshold."""
        self.formats = sorted(k for k in samples if k != "background" and not k.startswith("content"))
        self.machines, self.least, self.lengths = [], [], []
        for k in self.formats:
            cutoff = max(1, len(samples[k]) * 4 // 5)
            m = Chain(samples[k][:cutoff], PARTS.get(k)) if k in PARTS or len({x[:3] for x in samples[k]}) <= 8 else Automaton(samples[k][:cutoff], leave=False)
            held = samples[k][cutoff:] or samples[k]
            self.machines.append(m)
            self.least.append(float(np.quantile([m.bits(x) for x in held], 0.01)) - SLACK)
            self.lengths.append(AnyLength(min(map(len, samples[k]))) if k in PARTS else SeenLengths(samples[k]))
        heads = {k: {x[:HEAD] for x in samples[k]} for k in self.formats}
        self.heads = {k: h if len(h) <= 8 else None for k, h in heads.items()}  # None: the format has no fixed head
        self.background = Automaton(samples["background"], leave=False)
        self.content = [Automaton(samples[k], leave=False) for k in sorted(samples) if k.startswith("content")]
        rng = random.Random(3)
        other = [w for k, own in samples.items() for x in own[:2000:5] for w in re.findall("[a-z0-9]+", x.lower())] + ["".join(rng.choices(HEX + "ghijklmnopqrstuvwxyz", k=rng.randint(2, 12))) for _ in range(2000)]
        self.context = Context(CREDENTIAL_WORDS, DIGEST_WORDS, other)
        self.sizes = sorted({n for x in self.lengths if isinstance(x, SeenLengths) for n in x.seen})
        self.parts = np.array([isinstance(x, AnyLength) for x in self.lengths])
        self.walker = Walker([*self.machines, self.background, *self.content])
        self.margin = margin

    def score(self, candidates: list[str]) -> list[tuple[str, float] | None]:
        """(format, bits a symbol over the background) of each candidate, or None; without what stands before it."""
        return [x and x[:2] for x in self._score(candidates)]

    def _score(self, candidates: list[str]) -> list[tuple[str, float, float, bool, bool] | None]:
        """The same with the bits a symbol under the format, whether it has such lengths, and whether it may as well be content."""
        out: list[tuple[str, float, float, bool, bool] | None] = [None] * len(candidates)
        order = sorted(range(len(candidates)), key=lambda k: -len(candidates[k]))
        at = 0
        while at < len(order):  # in groups of a bounded number of symbols
            n = max(1, CELLS // max(1, len(candidates[order[at]])))
            self._score_group(candidates, order[at : at + n], out)
            at += n
        return out

    def _score_group(self, candidates: list[str], order: list[int], out: list) -> None:
        lengths = np.array([len(candidates[k]) for k in order])
        symbols = np.zeros((len(order), lengths[0]), np.uint8)
        for row, k in enumerate(order):
            symbols[row, : lengths[row]] = np.frombuffer(candidates[k].encode(), np.uint8)
        for row, found in self._judge(self.walker.bits(symbols, lengths), lengths):
            out[order[row]] = found

    def _judge(self, bits: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, tuple[str, float, float, bool, bool]]]:
        """(row, what _score gives) of the candidates, by the bits of all automata, that are likely enough under a format."""
        best, top, own, alike = self._best(bits, lengths)
        for row in np.flatnonzero(top >= self.margin).tolist():
            j, n = int(best[row]), int(lengths[row])
            yield row, (self.formats[j], round(float(top[row]), 6), float(own[row]), n in self.lengths[j], bool(alike[row]))

    def _best(self, bits: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each candidate the best format, its bits a symbol over the background, those under the format, and whether it may as well be content."""
        f = len(self.formats)
        own, base, content = bits[:, :f], bits[:, f], bits[:, f + 1 :].max(axis=1, initial=-np.inf)
        different, which = np.unique(lengths, return_inverse=True)
        size = np.array([[x[n] / n for x in self.lengths] for n in different.tolist()])[which]
        value = np.where(own >= np.array(self.least), own + size - base[:, None], -np.inf)
        best, rows = value.argmax(axis=1), np.arange(len(lengths))
        top, likely = value[rows, best], own[rows, best]
        alike = np.zeros(len(lengths), bool)
        some = top >= self.margin
        alike[some] = ((likely + size[rows, best] - content) * lengths)[some] < ALIKE
        return best, top, likely, alike

    def inner(self, text: str, kind: str, score: float, bits: float) -> bool:
        """Whether a finding can be a span within a run: by the head that its format has, or by the bits it saves."""
        heads = self.heads[kind]
        return text[:HEAD] in heads if heads else bits + EQUAL + SLACK > 0

    def spans(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of the candidates of a run that are written out: the whole, those of up to SPAN pieces, those of a format's lengths, and the longest that a format of parts accepts."""
        starts, stops = cuts(run)
        ends = set(stops)
        found = {(0, len(run))} | {(a, a + n) for a in starts for n in self.sizes if a + n in ends}
        for a in starts:
            k = bisect_right(stops, a + MIN_LENGTH - 1)
            reach = bisect_right(stops, a) + 2 * SPAN
            found |= {(a, b) for b in stops[k:reach]}
        for m, sizes in zip(self.machines, self.lengths):
            if isinstance(sizes, AnyLength):
                found |= {(a, b) for a, b in reaches(m, run, starts, ends)[0].items() if b - a in sizes}
        return sorted(found)

    def distant(self, text: str, at: int, run: str, near: dict[tuple[int, int], tuple[str, float, float, bool]]) -> None:
        """Add to `near`, the findings of a run at their (start, end) in it, those of more than SPAN pieces that count.

        First those in the language of a format of parts, for each start the longest; then, between all findings of lengths that their formats have, the others.
        """
        starts, stops = cuts(run)
        if len(stops) <= 2 * SPAN:
            return
        symbols, own = np.frombuffer(run.encode(), np.uint8), {k: f for k, f in near.items() if f[3]}
        limit = np.zeros((len(starts), len(self.formats)), np.int64)
        for j in np.flatnonzero(self.parts):
            covered, found = 0, {a: b for (a, b), f in sorted(own.items()) if f[0] == self.formats[j]}
            final = reaches(self.machines[j], run, starts, set(stops))[1]
            for row, a in enumerate(starts):
                covered = max(covered, found.get(a, 0))
                if final.get(a, 0) > covered and final[a] - a in self.lengths[j]:
                    limit[row, j] = final[a]
        if limit.any():
            longest: dict[tuple[int, str], int] = {}
            for a, b, found in self._far(text, at, symbols, 0, np.array(starts), np.array(stops), limit):
                if found[3] and b > longest.get((a, found[0]), 0):
                    near.pop((a, longest.get((a, found[0]), 0)), None)
                    longest[a, found[0]], near[a, b], own[a, b] = b, found, found
        free, places = 0, (np.array(starts), np.array(stops))
        for a, b in [*sorted(own), (len(run), len(run))]:
            inside, ends = (x[np.searchsorted(x, free) : np.searchsorted(x, a, side="right")] for x in places)
            if len(ends) > 2 * SPAN:
                others = {k: f for k, f in near.items() if not f[3] and free <= k[0] and k[1] <= a}
                near |= self._apart(symbols[:a], free, inside, ends, *self._open(text, at, run, symbols[free:a], free, inside), others)
            free = max(free, b)

    def _open(self, text: str, at: int, run: str, symbols: np.ndarray, low: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, formats): whether a span of a length that the format hasn't, within these symbols from `low` on, can be a finding, by its head or by the words before it;
        and whether these words tell of credentials."""
        out = np.zeros((len(starts), len(self.formats)), bool)
        words = np.array([self.context.before(text, at + a) == "credential" for a in starts.tolist()], bool)
        for j, k in enumerate(self.formats):
            if self.parts[j]:
                continue
            if self.heads[k]:
                out[:, j] = [run[a : a + HEAD] in self.heads[k] for a in starts.tolist()]
                continue
            unlike = np.ones(len(starts), bool)  # where it may be no content: as much likelier by the format as its length costs
            for content in self.content:
                gain = self.machines[j].log.max(axis=0) - content.log[:-1].min(axis=0)
                total = np.concatenate(([0.0], np.cumsum(gain[symbols], dtype=np.float64)))
                unlike &= (most_from(total) - total)[starts - low] >= ALIKE - UNSEEN_BITS - 1e-3
            out[:, j] = words | unlike
        return out, words

    def _apart(self, symbols: np.ndarray, low: int, starts: np.ndarray, stops: np.ndarray, opened: np.ndarray, words: np.ndarray, near: dict[tuple[int, int], tuple[str, float, float, bool]]) -> dict[tuple[int, int], tuple[str, float, float, bool]]:
        """Those findings of more than SPAN pieces, of lengths that their formats haven't, that beside `near` can be among the ones that save the most bits in sum.

        The starts are walked side by side, with the most bits that are saved before each. At every stop the best finding that ends there is taken down if it
        saves more than was saved so far. A start that another in the same states excels, with what is saved before them, at all stops to come is left out.
        """
        k = np.maximum(np.searchsorted(stops, starts + MIN_LENGTH - 1, side="right"), np.searchsorted(stops, starts, side="right") + 2 * SPAN)
        rows = np.flatnonzero((k < len(stops)) & opened.any(axis=1))
        if not len(rows):
            return {}
        starts, first, opened, words = starts[rows], stops[k[rows]], opened[rows], words[rows]
        ahead, future = self._ahead(symbols[low:])
        last = self._last(symbols[low:], starts - low, first - low, np.where(opened, len(symbols) - low, 0), ahead, future) + low
        rows = np.flatnonzero(last >= first)
        starts, first, last, opened, words = starts[rows], first[rows], last[rows], opened[rows], words[rows]
        f, least, w = len(self.formats), np.array(self.least), self.walker
        fixed = np.array([bool(self.heads[x]) for x in self.formats])
        ending: dict[int, list[tuple[int, float]]] = {}
        for (a, b), x in sorted(near.items()):
            ending.setdefault(b, []).append((a, max((b - a) * x[1], 1e-6)))
        stop, best, now = set(stops.tolist()), np.zeros(len(symbols) + 1), 0.0
        out: dict[tuple[int, int], tuple[str, float, float, bool]] = {}
        live, q, total, before = np.zeros(0, np.int64), np.zeros((0, len(w.start)), np.int32), np.zeros((0, len(w.start))), np.zeros(0)
        new, checked = 0, 0
        for place in range(low, len(symbols)):
            best[place] = now
            if new < len(starts) and starts[new] == place:
                live, before = np.append(live, new), np.append(before, now)
                q, total = np.concatenate((q, w.start[None])), np.concatenate((total, np.zeros((1, len(w.start)))))
                new += 1
            if not len(live) and new == len(starts):
                break
            total += w.log[q, symbols[place]]
            q = w.next[q, symbols[place]]
            end = place + 1
            if end not in stop:
                continue
            value, chosen = now, None
            for a, bits in ending.get(end, ()):
                if best[a] + bits > value:
                    value, chosen = best[a] + bits, (a, None)
            n = end - starts[live]
            ripe = np.flatnonzero((first[live] <= end) & ~np.isin(n, self.sizes))
            if len(ripe):
                own = live[ripe]
                j, top, likely, alike = self._best((total[ripe] + w.end[q[ripe]]) / n[ripe, None], n[ripe])
                good = (top >= self.margin) & ~self.parts[j] & np.where(fixed[j], opened[own, j], likely + EQUAL + SLACK > 0) & (~alike | words[own])
                saves = np.where(good, before[ripe] + np.maximum(n[ripe] * np.round(top, 6), 1e-6), -np.inf)
                row = int(saves.argmax())
                a = int(starts[own[row]])
                if saves[row] > value or (chosen and saves[row] == value and a < chosen[0]):
                    value, chosen = float(saves[row]), (a, (self.formats[j[row]], round(float(top[row]), 6), float(likely[row]), False))
            now = value
            if chosen and chosen[1]:
                out[chosen[0], end] = chosen[1]
            keep = last[live] > end
            if len(live) >= 2 * checked + 8:
                keep &= self._excel(starts[live], end, q, total, before, first[live] <= end, opened[live], words[live], [y[end - low] - x[end - low] for x, y in zip(ahead, future)], 1e-6 * (len(symbols) - low + 1))
                checked = int(keep.sum())
            if not keep.all():
                live, q, total, before = live[keep], q[keep], total[keep], before[keep]
                checked = min(checked, len(live))
        return out

    def _excel(self, starts: np.ndarray, end: int, q: np.ndarray, total: np.ndarray, before: np.ndarray, ripe: np.ndarray, opened: np.ndarray, words: np.ndarray, more: list[np.ndarray], slack: float) -> np.ndarray:
        """Which walks to go on with: those that can still give a finding and that no other excels.

        Another excels a walk if from now on it moves through the same states, whatever it is likely enough under is a finding, and for every format that is
        open to the walk it has more bits by all bounds that a finding must reach, and in sum with those saved before. What their lengths cost draws nearer with every symbol.
        """
        f, least = len(self.formats), np.array(self.least)
        n = (end - starts)[:, None]
        can = np.ones((len(starts), f), bool)
        for have, ahead in zip((total[:, :f] - n * least, total[:, :f] - total[:, f, None] - n * self.margin), more):
            can &= have + ahead >= -1e-3
        can |= n < MIN_LENGTH
        keep = (can & opened).any(axis=1)
        fixed = np.array([bool(self.heads[x]) for x in self.formats])
        leads = ripe & keep & ~(can & ~opened).any(axis=1) & (words | ~(can & ~fixed).any(axis=1))
        size = -np.log2(n[:, 0]) - np.log2(n[:, 0] + 1)
        groups: dict[bytes, list[int]] = {}
        for row in np.flatnonzero(keep).tolist():
            groups.setdefault(q[row].tobytes(), []).append(row)
        for some in groups.values():
            rows = np.array(some)
            able = rows[leads[rows]]
            if len(rows) < 2 or not len(able):
                continue
            gain = before + (total[:, :f] - total[:, f, None]).max(axis=1)
            for lead in {int(able[0]), int(able[gain[able].argmax()])}:
                if not keep[lead]:
                    continue
                longer = (starts[rows] - starts[lead])[:, None]
                more_bits, costs = total[lead] - total[rows], np.minimum(size[lead] - size[rows], 0)[:, None]
                bits, content = more_bits[:, :f], more_bits[:, f + 1 :].max(axis=1, initial=-np.inf)[:, None]
                over = bits - more_bits[:, f, None] + costs
                well = (bits - least * longer >= 1e-6) & (fixed | (bits + (EQUAL + SLACK) * longer >= 1e-6)) & (over - self.margin * longer >= 1e-6) & (over + (before[lead] - before[rows])[:, None] >= slack)
                well &= words[lead] | (~words[rows][:, None] & (bits - content + costs >= 1e-6))
                excelled = (well | ~(can & opened)[rows]).all(axis=1) & (rows != lead)
                keep[rows[excelled]] = False
        return keep

    def _far(self, text: str, at: int, symbols: np.ndarray, low: int, starts: np.ndarray, stops: np.ndarray, limit: np.ndarray) -> Iterator[tuple[int, int, tuple[str, float, float, bool]]]:
        """(start, end, finding) of the findings of more than SPAN pieces, from each start to its format's limit (starts, formats) at most; nothing before `low` is read."""
        k = np.maximum(np.searchsorted(stops, starts + MIN_LENGTH - 1, side="right"), np.searchsorted(stops, starts, side="right") + 2 * SPAN)
        rows = np.flatnonzero(np.append(stops, len(symbols) + 1)[np.minimum(k, len(stops))] <= limit.max(axis=1))
        if not len(rows):
            return
        starts, first, high = starts[rows], stops[k[rows]], int(limit.max())
        last = self._last(symbols[low:high], starts - low, first - low, limit[rows] - low, *self._ahead(symbols[low:high])) + low
        rows = np.flatnonzero(last >= first)
        stop = np.zeros(len(symbols) + 1, bool)
        stop[stops] = True
        run = symbols.tobytes().decode()
        for a, n, bits in self.walker.spans(symbols, starts[rows], first[rows], last[rows], stop):
            for row, found in self._judge(bits, n):
                start, length = int(a[row]), int(n[row])
                if self.inner(run[start : start + HEAD], *found[:3]) and self.taken(text, at + start, length, *found[3:]):
                    yield start, start + length, found[:4]

    def _last(self, symbols: np.ndarray, starts: np.ndarray, first: np.ndarray, limit: np.ndarray, ahead: list[np.ndarray], future: list[np.ndarray]) -> np.ndarray:
        """For each start the last end, from first to limit, up to which a format can be likely enough by upper bounds of its bits, or -1.

        The first MIN_LENGTH symbols are walked. A later symbol has at most the bits that it has in any state in which a walk of MIN_LENGTH symbols can be there.
        """
        out, f = np.full(len(starts), -1), len(self.formats)
        for some in np.split(np.arange(len(starts)), range(LANES, len(starts), LANES)):
            a = starts[some]
            total, _ = self.walker.walk(symbols[a[:, None] + np.arange(MIN_LENGTH)], np.full(len(a), MIN_LENGTH))
            have = total[:, :f] - MIN_LENGTH * np.array(self.least), total[:, :f] - total[:, f, None] - MIN_LENGTH * self.margin
            for j in range(f):
                end = limit[some, j].copy()
                for h, x, y in zip(have, ahead, future):
                    least = x[a + MIN_LENGTH, j] - h[:, j] - 1e-3
                    end = np.minimum(end, len(y) - 1 - np.searchsorted(y[::-1, j], least, side="left"))
                out[some] = np.maximum(out[some], np.where(end >= first[some], end, -1))
        return out

    def _ahead(self, symbols: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Sums up to each place of what a symbol adds at most to the bits over a format's least and to those over the background and MARGIN, and their largest from there on."""
        most, base = self._bounds(symbols)
        ahead = [np.concatenate((np.zeros((1, most.shape[1])), np.cumsum(x, axis=0))) for x in (most - np.array(self.least), most - base[:, None] - self.margin)]
        return ahead, [np.stack([most_from(x[:, j]) for j in range(x.shape[1])], axis=1) for x in ahead]

    def _bounds(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place from MIN_LENGTH on the most bits of its symbol under each format and the least under the background, over the states that walks of MIN_LENGTH symbols lead to."""
        most, least = np.zeros((len(symbols), len(self.formats))), np.zeros(len(symbols))
        for low in range(MIN_LENGTH, len(symbols), LANES):
            places = np.arange(low, min(len(symbols), low + LANES))
            for j, m in enumerate([*self.machines, self.background]):
                q = np.tile(np.arange(len(m.next) - (m is self.background)), (len(places), 1))  # the background is never left
                for t in range(MIN_LENGTH, 0, -1):
                    q = m.next[q, symbols[places - t, None]]
                bits = m.log[q, symbols[places, None]]
                if m is self.background:
                    least[places] = bits.min(axis=1)
                else:
                    most[places, j] = bits.max(axis=1)
        return most, least

    def taken(self, text: str, start: int, length: int, seen: bool, alike: bool) -> bool:
        """Whether a finding that may as well be content is reported, by the words before it and before each of its pieces."""
        if not alike:
            return True
        if not seen:
            return self.context.before(text, start) == "credential"
        pieces = {start, *(start + m.end() for m in BOUNDARY.finditer(text[start : start + length]))}
        return all(self.context.before(text, p) != "content" for p in pieces)

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """(start, length, format, score) of the findings of each text."""
        runs = [(k, m.start(), m.group()) for k, t in enumerate(texts) if t for m in CANDIDATE.finditer(t)]
        places = [(r, a, run[a:b]) for r, (_, _, run) in enumerate(runs) for a, b in self.spans(run)]
        by_run: dict[int, dict[tuple[int, int], tuple[str, float, float, bool]]] = {r: {} for r in range(len(runs))}
        for (r, a, x), found in zip(places, self._score([x for *_, x in places])):
            if found and (len(x) == len(runs[r][2]) or self.inner(x, *found[:3])) and self.taken(texts[runs[r][0]], runs[r][1] + a, len(x), *found[3:]):
                by_run[r][a, a + len(x)] = found[:4]
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        for r, findings in by_run.items():
            k, at, run = runs[r]
            self.distant(texts[k], at, run, findings)
            own, other = ([(at + a, b - a, *f[:3]) for (a, b), f in sorted(findings.items()) if f[3] is seen] for seen in (True, False))
            own = outermost(own)
            taken = [f[0] for f in own], np.maximum.accumulate([f[0] + f[1] for f in own]).tolist() if own else []
            other = [f for f in other if not (n := bisect_left(taken[0], f[0] + f[1])) or taken[1][n - 1] <= f[0]]
            out[k] += sorted(f[:4] for f in apart(own) + apart(other))
        return out


def cuts(run: str) -> tuple[list[int], list[int]]:
    """Where spans of a run can start and end: at its ends and on both sides of its boundary symbols, and before the signs that fill it up."""
    inner = {x for m in BOUNDARY.finditer(run) for x in (m.start(), m.end())}
    return sorted({0, *inner}), sorted({*inner, len(run), len(run.rstrip("="))})


def most_from(totals: np.ndarray) -> np.ndarray:
    """The largest of the totals from each place on."""
    return np.maximum.accumulate(totals[::-1])[::-1]


def reaches(m: Automaton, run: str, starts: list[int], ends: set[int]) -> tuple[dict[int, int], dict[int, int]]:
    """For each start the last end that m accepts. Walks that meet in a state go on as one, from the earliest start: first without the ends that others
    have from there on, then with them."""
    symbols, begin, out = run.encode(), set(starts), m.next.shape[0] - 1
    walks, last = {}, {}
    met: dict[int, tuple[int, int]] = {}
    for j, c in enumerate(symbols):
        if j in begin:
            if 0 in walks:
                met[j] = walks[0], j + 1
            else:
                walks[0] = j
        elif not walks:
            continue
        moved: dict[int, int] = {}
        for q, start in sorted(walks.items(), key=lambda x: x[1]):
            if (to := int(m.next[q, c])) == out:
                continue
            if to in moved:
                met[start] = moved[to], j + 1
            else:
                moved[to] = start
        walks = moved
        if j + 1 in ends:
            for q, start in walks.items():
                if m.end[q] == 0:
                    last[start] = j + 1
    final = dict(last)
    for start, (other, place) in sorted(met.items()):
        if final.get(other, 0) >= place:
            final[start] = final[other]
    return last, final


def outermost(findings: list[tuple[int, int, str, float, float]]) -> list[tuple[int, int, str, float, float]]:
    """The findings that aren't within another of their format."""
    kept, reach = [], {}
    for f in sorted(findings, key=lambda f: (f[0], -f[1])):
        if f[0] + f[1] > reach.get(f[2], 0):
            kept.append(f)
            reach[f[2]] = f[0] + f[1]
    return kept


def apart(findings: list[tuple[int, int, str, float, float]]) -> list[tuple[int, int, str, float, float]]:
    """The findings that don't overlap and save the most bits in sum, by place."""
    findings = sorted(findings, key=lambda f: (f[0] + f[1], f[0]))
    ends = [f[0] + f[1] for f in findings]
    best, before = [0.0], []
    for k, f in enumerate(findings):
        before.append(bisect_right(ends, f[0], 0, k))
        best.append(max(best[k], best[before[k]] + max(saved(f), 1e-6)))  # a finding without a rival is kept
    kept, k = [], len(findings)
    while k:
        if best[k] > best[k - 1]:
            kept.append(findings[k - 1])
            k = before[k - 1]
        else:
            k -= 1
    return kept[::-1]


def saved(finding: tuple[int, int, str, float, float]) -> float:
    """Bits that the format saves over the background."""
    return finding[1] * finding[3]


@lru_cache(maxsize=1)
def fit() -> Scanner:
    return Scanner(labelled())


def scan_udf(scanner: Scanner):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("format", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<start:int,length:int,format:string,score:double>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("start", "length", "format", "score")
        for texts in batches:
            yield pa.array([[dict(zip(names, f)) for f in x] for x in scanner.scan(texts.to_pylist())], kind)

    return scan


def find_secrets(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, format, score, sha256, preview) of every finding; the secret itself isn't copied."""
    hits = exact(docs, id_col, text_col).toDF("doc_id", "t").select("doc_id", "t", F.explode(scan_udf(scanner)(F.col("t"))).alias("h")).select("doc_id", "t", "h.*")
    secret = F.substring(F.col("t"), F.col("start") + 1, F.col("length"))
    return hits.select("doc_id", "start", "length", "format", "score", F.sha2(secret, 256).alias("sha256"), F.concat(F.substring(secret, 1, 4), F.lit("...")).alias("preview"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(load(spark, sf_dir, "documents"), fit())
