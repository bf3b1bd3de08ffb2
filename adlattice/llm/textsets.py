"""Words, segments, shingles and SuperMinHash signatures of batches of texts.

A batch is tokenised once into an array of token ids; everything after that (shingle hashes, sets,
signatures, n-gram features) is vectorised over the batch.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import numpy as np

_CJK = "぀-ヿ㐀-鿿가-힯豈-﫿"
BREAK = "\n"
# A bracket notation is written as an opening sign of its kind, the words inside and a closing sign.
OPEN, CLOSE = "".join(map(chr, range(0xE000, 0xE020))), "\ue07f"
TOKEN = re.compile(rf"[{_CJK}]|[^\W{_CJK}]+|\n|[{OPEN}{CLOSE}]|[.!?。！？](?=\s|$)")
BLOCK_TAG = re.compile(r"</?(?:p|li|ul|ol|br|div|html|head|body|title|h[1-6]|noscript|tr|td|table)\b[^>]*>", re.I)
ANY_TAG = re.compile(r"</?[a-z!][^<>]*>", re.I)
ERROR_MARK = re.compile(r"Error: \w+\s*")
SENTINELS = ("", "N/A")
_U = np.uint64
GOLDEN = _U(0x9E3779B97F4A7C15)

# Tags of three letters or more that adverts are laid out with; in capitals they are no notations.
_TAGS = "DIV|SPAN|STRONG|FONT|CENTER|BIG|SMALL|STRIKE|DEL|INS|SUB|SUP|PRE|BLOCKQUOTE|TABLE|THEAD|TBODY|TFOOT|COL|COLGROUP|IMG|WBR|HTML|HEAD|BODY|META|STYLE|SCRIPT|NOSCRIPT|IFRAME|SECTION|ARTICLE|HEADER|FOOTER|ASIDE|NAV"
# Bracket notations, by kind: a to i and p to t are the syntaxes of template languages and mail merges, j to o and u to x
# occur in ordinary texts too. None has a bound on its length but the end of the line (tags may span none).
PLACEHOLDER = re.compile(
    r"\{%(?P<b>[^{}%\n]+)%\}|\{\{(?P<a>[^{}\n]+)\}\}|\$\{(?P<c>[^{}\n]+)\}|%%(?P<d>[^%\n]+)%%|\[\[(?P<e>[^\[\]\n]+)\]\]|<<(?P<f>[^<>\n]+)>>"
    r"|@@(?P<g>[^@\n]+)@@|(?<!\w)#(?P<h>[^\W\d][\w ]*)#(?!\w)|(?<![^\W_])__(?P<i>[^\W_][\w ]*?)__(?![^\W_])|\[(?P<j>[^\[\]\n]+)\]|(?<![{$])\{(?P<k>[^{}\n\"':;]+)\}(?!\})"
    r"|&lt;(?P<l>[^&<>\n]+)&gt;|【(?P<m>[^【】\n]+)】|\((?P<n>[^()\n]+) to be [a-z]+\)|(?P<o>_{5,})|<%=?(?P<p>[^%<>\n]+)%>|\*\|(?P<q>[^*|\n]+)\|\*"
    r"|<\?=?(?P<r>[^<>?\n]+(?:->[^<>?\n]+)?)\?>|«(?P<s>[^«»\n]+)»|" rf"<(?P<t>[A-Za-z]+_\w+|(?!(?:{_TAGS})>)[A-Z]{{3,}}(?: [A-Z]+)*)>" r"|\*\*(?P<u>(?:add|insert|enter|write|describe|fill in)\b[^*\n]{2,})\*\*|\((?P<v>(?:enter|insert|add|fill in|your)\b[^()\n]{2,})\)|\$(?P<x>[A-Za-z_]{2,})\$|\b(?P<w>X{2,4})(?= (?:years|months|people|hours|days|staff))"
)
_ANGLE = re.compile(r"<[A-Z<?%]")
_TOKENS = re.compile(r"&lt;|XX| to be |\((?:enter|insert|add|fill|your)")


def _may_hold(t: str) -> bool:
    """Whether a text has a sign that every notation has; plain search for signs is quicker than a pattern."""
    return "{" in t or "[" in t or "%" in t or "#" in t or "@" in t or "_" in t or "$" in t or "*" in t or "&lt;" in t or "XX" in t or " to be " in t or "<" in t and _ANGLE.search(t) is not None or "(" in t and _TOKENS.search(t) is not None or not t.isascii() and ("«" in t or "【" in t)


_ENDS = re.compile(r"[\n.!?。！？]")
_SIGNS = re.compile(f"[{OPEN}{CLOSE}]")


def is_advert(text: str | None) -> bool:
    """False for NULL, blank, 'N/A' and error marks."""
    return text is not None and text.strip() not in SENTINELS and not ERROR_MARK.fullmatch(text)


def plain(text: str) -> str:
    """Tags become breaks or blanks, entities are decoded, case is folded."""
    if "<" in text:
        text = ANY_TAG.sub(" ", BLOCK_TAG.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    if ";  " in text:
        text = text.replace(";  ", ";\n")
    if "•" in text:
        text = text.replace("•", " ")  # the most usual sign that is no letter; without it most texts are ASCII
    return text.casefold()


def _marked(m: re.Match) -> str:
    inner = "" if m.lastgroup == "o" else _ENDS.sub(" ", m[m.lastgroup]).strip()
    return f" {OPEN[ord(m.lastgroup) - 97]}{inner} {CLOSE} "


def masked(text: str) -> str:
    """Bracket notations as opening sign, inner words and closing sign; such signs in the text itself go."""
    if not text.isascii():
        text = _SIGNS.sub(" ", text)
    return PLACEHOLDER.sub(_marked, text) if _may_hold(text) else text


# A word's hash is mixed from the sum of (byte + 1) times powers of a fixed odd number, so that the hashes of all words of a
# block of bytes come from one running sum.
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_UNBASE = pow(_BASE, -1, 1 << 64)
PLAIN_BLOCK = 1 << 18


def word_hash(word: str) -> int:
    total, power = 0, 1
    for c in word.encode():
        total += (c + 1) * power
        power = power * _BASE & _MASK
    return int(mix(np.array([total & _MASK], np.uint64))[0])


_powers: list[np.ndarray] = []


def _power_rows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, for blocks of up to ``n`` bytes."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PLAIN_BLOCK + 1)
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)))) for x in (_BASE, _UNBASE)]
    return _powers[0], _powers[1]


# Classes of the ASCII characters: 1 word, 2 digit, 3 line break, 4 end mark, 5 white space or end of a text.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[c for c in range(128) if chr(c).isalnum() or c == 95]] = 1
_CLASS[48:58] = 2
_CLASS[[9, 11, 12, 13, 28, 29, 30, 31, 32, 0]] = 5
_CLASS[10] = 3
_CLASS[[33, 46, 63]] = 4


def plain_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, hash, kind)`` of the tokens of ASCII texts, as :class:`Vocabulary` gives them, by whole arrays."""
    data = ("\0".join(t.replace("\0", "\1") for t in texts) + "\0").encode()
    raw = np.frombuffer(data, np.uint8)
    kinds = _CLASS[raw]
    word = (kinds == 1) | (kinds == 2)
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    after = np.append(kinds[1:], 5)
    brk = np.flatnonzero((kinds == 3) | (kinds == 4) & ((after == 5) | (after == 3)))
    up, down = _power_rows(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * up[: len(raw)], out=total[1:])
    digits = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(kinds == 2, out=digits[1:])
    hashes = mix((total[end] - total[begin]) * down[begin])
    at = np.concatenate((begin, brk))
    order = np.argsort(at, kind="stable")
    h = np.concatenate((hashes, np.zeros(len(brk), np.uint64)))[order]
    kind = np.concatenate((np.where(digits[end] - digits[begin] == end - begin, 3, 0), np.ones(len(brk), np.int64))).astype(np.int8)[order]
    starts = np.flatnonzero(raw == 0)  # where each text ends
    return np.searchsorted(starts, at[order]), h, kind


class Vocabulary(dict):
    """Token -> id, with per-id hashes. It is a cache: past ``limit`` tokens it starts anew between batches."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.h: list[int] = []
        self.kind: list[int] = []

    def __missing__(self, token: str) -> int:
        i = self[token] = len(self.h)
        kind = 1 if token in "\n.!?。！？" else 2 if token in OPEN else 4 if token == CLOSE else 3 if token.isdigit() else 0
        self.h.append(0 if kind == 1 else word_hash(token))
        self.kind.append(kind)
        return i

    def batch(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(doc number, hash, kind)`` of every token: kind 0 word, 1 end of a segment, 2 and 4 signs of a notation, 3 number.

        ASCII texts go through whole arrays, in blocks of about ``PLAIN_BLOCK`` bytes; others, and single texts beyond that,
        token by token, with the same result.
        """
        if len(self.h) > self.limit:
            self._reset()
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ids: list[int] = []
        counts: list[int] = []
        other: list[int] = []
        block: list[str] = []
        numbers: list[int] = []
        size = 0
        look = self.__getitem__

        def flush() -> None:
            doc, h, kind = plain_tokens(block)
            parts.append((np.array(numbers)[doc], h, kind))

        for n, t in enumerate(texts):
            if len(t) < PLAIN_BLOCK and t.isascii():
                if size + len(t) >= PLAIN_BLOCK:
                    flush()
                    block, numbers, size = [], [], 0
                block.append(t)
                numbers.append(n)
                size += len(t) + 1
            else:
                found = list(map(look, TOKEN.findall(t)))
                counts.append(len(found))
                other.append(n)
                ids += found
        if block:
            flush()
        if ids:
            at = np.array(ids, dtype=np.int64)
            parts.append((np.repeat(np.array(other), counts), np.array(self.h, dtype=np.uint64)[at], np.array(self.kind, dtype=np.int8)[at]))
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int8)
        doc, h, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(parts) > 1:
            order = np.argsort(doc, kind="stable")
            doc, h, kind = doc[order], h[order], kind[order]
        return doc, h, kind


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEPS = np.arange(1, 129, dtype=np.uint64) * GOLDEN
_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64) * GOLDEN) | _U(1)


VALUE_BITS = 48
MAX_TEXTS = 1 << (64 - VALUE_BITS)


def shingle_sets(doc: np.ndarray, h: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes (48 bits) of runs of k words per document, as ``(values, offsets)``.

    A text of fewer than k words has its one short run, so that equal short texts are equal. The number of the document
    rides on the upper bits, so that one plain sort orders all sets.
    """
    if n_docs > MAX_TEXTS:
        raise ValueError(f"at most {MAX_TEXTS} texts at a time")
    if not len(h):
        return np.empty(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    size = np.bincount(doc, minlength=n_docs)
    ends = np.cumsum(size)
    left = ends[doc] - np.arange(len(h))  # words from here to the end of the document
    run = h * _MULTIPLIERS[0]
    for j in range(1, k):
        part = h[j:] * _MULTIPLIERS[j]
        inner = left[: len(h) - j] > j
        part[~inner] = 0
        run[: len(h) - j] += part
    keep = (left >= k) | ((size[doc] < k) & (left == size[doc]))
    both = (doc[keep].astype(np.uint64) << _U(VALUE_BITS)) | (mix(run[keep]) >> _U(64 - VALUE_BITS))
    both.sort()
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    d = (both >> _U(VALUE_BITS)).astype(np.int64)
    return both & _U((1 << VALUE_BITS) - 1), np.concatenate(([0], np.cumsum(np.bincount(d, minlength=n_docs))))


def set_hashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 63-bit number per set; equal sets have equal numbers, an empty set has 0."""
    n = len(offsets) - 1
    total = np.zeros(n, np.uint64)
    full = np.diff(offsets) > 0
    if full.any():
        total[full] = np.add.reduceat(mix(values + GOLDEN), offsets[:-1][full])
    return (mix(total + np.diff(offsets).astype(np.uint64)) >> _U(1)).astype(np.int64) * full


ELEMENTS = 400_000


def superminhash(values: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m 64-bit values per set; an empty set gets equal values.

    In step j each element draws r_j in [0, 1) and the j-th place of its own random permutation (a lazy
    Fisher-Yates shuffle) and offers r_j + j there. As offers of later steps are at least j + 1, a set
    whose m minima are all below j + 1 is finished: few steps are needed for sets larger than m.
    """
    if m > 128:
        raise ValueError("at most 128 places")
    n = len(offsets) - 1
    out = np.full(n * m, np.inf)
    all_docs = np.repeat(np.arange(n), np.diff(offsets))
    # blocks bound the memory of long texts; minima of blocks combine
    for lo in range(0, len(values), ELEMENTS):
        doc, v = all_docs[lo : lo + ELEMENTS], values[lo : lo + ELEMENTS]
        swaps: list[np.ndarray] = []
        for j in range(m):
            if not len(v):
                break
            bits = mix(v + _STEPS[j])
            k = (((bits & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int16)
            k += j
            # the shuffle is replayed backwards instead of kept: index k holds what the last swap with it put there
            place = k.copy()
            for i in range(j - 1, -1, -1):
                place[swaps[i] == place] = i
            at = doc * m + place
            # places filled in earlier steps hold less than j
            free = np.flatnonzero(out[at] >= j)
            r = (bits[free] >> _U(11)).astype(np.float64) * (1.0 / (1 << 53))
            np.minimum.at(out, at[free], r + j)
            if j + 1 < m:
                live = (out.reshape(n, m).max(axis=1) >= j + 1)[doc]
                swaps.append(k)
                if not live.all():
                    v, doc = v[live], doc[live]
                    swaps = [x[live] for x in swaps]
    return mix(np.where(np.isinf(out), 0.0, out).view(np.uint64)).reshape(n, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per document and band, from ``rows`` places of the signature: places of their own if there
    are enough, else drawn anew for each band."""
    rng = np.random.default_rng(1)
    apart = rng.permutation(sig.shape[1])[: bands * rows].reshape(bands, rows) if bands * rows <= sig.shape[1] else None
    keys = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for i, place in enumerate(np.sort(rng.permutation(sig.shape[1])[:rows] if apart is None else apart[b])):
            key += sig[:, place] * _MULTIPLIERS[i]
        keys[:, b] = mix(key)
    return keys


def bit_sketch(sig: np.ndarray, bits: int = 1) -> np.ndarray:
    """``bits`` bits of each place, packed: sets of similarity s agree in a share s + (1 - s) / 2^bits of the places."""
    return np.concatenate([np.packbits(((sig >> _U(i)) & _U(1)).astype(np.uint8), axis=1) for i in range(bits)], axis=1)
