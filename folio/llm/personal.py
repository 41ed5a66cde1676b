"""Personal data: patterns for what has a form, and a linear-chain conditional random field over word shapes for the rest.

The patterns' spans always stay. The field labels every word of every text from its shape, its first letters and the
shapes beside it; it is trained on a small labelled table and decoded by Viterbi for many lines of words at once in numpy.
A run of words that it labels alike becomes a further span where no pattern has one and what it holds can be of its kind at all
(`plausible`), which keeps links, versions, lists of numbers and the like out. Null text is empty.
Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import Rolling, documents, mix, text_slices, utf8, words

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Labels of the field: 0 is none of the kinds.
LABELS = ("", *KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't begin within a run of digits whose start doesn't match, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind's number, start and end of each pattern's spans, by kind and then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15] if "+" in text else []
    return out


# Word shapes ------------------------------------------------------------------------------------------------------

_CLASS = np.full(256, 5, np.uint8)  # other signs
_CLASS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[list(b"@=:+")] = 4
_CLASS[list(b".,;!?*#$%&\"'()|")] = 6
FEATURE_BINS = 1 << 14
FEATURES = 7


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Bins of each word's features: squeezed shape, that of its core, length, digits, first letters, and the shapes beside it."""
    if not len(start):
        return np.zeros((0, FEATURES), np.int64)
    kind = _CLASS[data]
    trimmed = kind != 6
    # the squeezed shape: a class counts where it differs from the one before, in the word
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[start] = True
    where = np.flatnonzero(new)
    rolling = Rolling(kind[where])
    a, b = np.searchsorted(where, start), np.searchsorted(where, end)
    shape = rolling.at(a, b - a)
    before = np.concatenate(([0], np.cumsum(trimmed)))
    digits = np.concatenate(([0], np.cumsum(kind == 3)))
    upper = np.concatenate(([0], np.cumsum(kind == 2)))
    letters = before[end] - before[start]
    n_digits = digits[end] - digits[start]
    n_upper = upper[end] - upper[start]
    first = Rolling(data).at(start, np.minimum(end - start, 4))
    size = np.minimum(letters, 48) // 4
    bits = np.minimum(n_digits, 20) // 2 * np.int64(64) + np.minimum(n_upper, 20) // 4 * 8 + ((n_digits > 0) & (n_digits < letters)) * 4
    same = np.concatenate(([False], line[1:] == line[:-1]))
    left = np.where(same, np.concatenate(([np.uint64(0)], shape[:-1])), np.uint64(1))
    right = np.where(np.concatenate((same[1:], [False])), np.concatenate((shape[1:], [np.uint64(0)])), np.uint64(1))
    numbers = [shape, shape + size.astype(np.uint64), size.astype(np.uint64), bits.astype(np.uint64), first, left ^ (shape << np.uint64(1)), right ^ (shape << np.uint64(1))]
    return np.stack([(mix(x + np.uint64(k * 1_000_003)) % np.uint64(FEATURE_BINS)).astype(np.int64) for k, x in enumerate(numbers)], axis=1)


@dataclass
class Field:
    """Weights of features by label, of pairs of neighbouring labels (from, to), and of first labels."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray


def _ordered(line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the lines, longest first, their lengths, and how many reach each position."""
    starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(line)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    reach = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    return starts, lengths, reach


#: Words of a line that are decoded one after the other; its further blocks are decoded beside them, from every label before.
BLOCK_WORDS = 48


def _block_paths(field: Field, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best scores of blocks by label before them (begin: blocks by that label by first label) and last label, and the labels
    that lead there at each step. Blocks come longest first."""
    reach = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")
    best, back = begin.copy(), []
    for t in range(1, len(reach)):
        live = reach[t]
        options = best[:live, :, :, None] + field.step
        back.append(options.argmax(axis=2).astype(np.int8))
        best[:live] = options.max(axis=2) + scores[starts[:live] + t][:, None, :]
    return best, back


def viterbi(field: Field, scores: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The likeliest label of each word of whole lines. All blocks of all lines take a step at once: a line's later blocks for each
    label that the one before may end with, which its blocks in order then tell."""
    labels = np.zeros(len(scores), np.int8)
    if not len(scores):
        return labels
    n = scores.shape[1]
    step, first = field.step.astype(scores.dtype), field.first.astype(scores.dtype)
    field = Field(field.emit, step, first)
    heads = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    sizes = np.diff(np.append(heads, len(line)))
    many = -(-sizes // BLOCK_WORDS)
    owner = np.repeat(np.arange(len(heads)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    start = heads[owner] + nth * BLOCK_WORDS
    length = np.minimum(BLOCK_WORDS, sizes[owner] - nth * BLOCK_WORDS)
    parts = []
    best = np.zeros((len(owner), n, n), scores.dtype)  # of a first block only the first label before is used
    for blocks in (np.flatnonzero(nth == 0), np.flatnonzero(nth > 0)):
        blocks = blocks[np.argsort(-length[blocks], kind="stable")]
        if not len(blocks):
            continue
        own = scores[start[blocks]][:, None, :]
        begin = own + (first[None, None] if nth[blocks[0]] == 0 else step[None])
        ends, back = _block_paths(field, scores, start[blocks], length[blocks], np.ascontiguousarray(np.broadcast_to(begin, (len(blocks), begin.shape[1], n))))
        best[blocks, : ends.shape[1]] = ends
        parts.append((blocks, back))
    # along the blocks of each line, all lines at once: longest first
    before = np.zeros((len(owner), n), np.int8)
    order = np.argsort(-many, kind="stable")
    at, reach = (np.cumsum(many) - many)[order], np.searchsorted(-many[order], -np.arange(int(many.max())), "left")
    state = best[at, 0]
    for k in range(1, len(reach)):
        live = reach[k]
        options = state[:live, :, None] + best[at[:live] + k]
        before[at[:live] + k] = options.argmax(axis=1)
        state[:live] = options.max(axis=1)
    # back along them: the label each ends with
    last = np.zeros(len(owner), np.int8)
    now = state.argmax(axis=1).astype(np.int8)
    for k in range(len(reach) - 1, -1, -1):
        live = reach[k]
        block = at[:live] + k
        last[block] = now[:live]
        if k:
            now[:live] = before[block, now[:live]]
    entered = np.where(nth > 0, before[np.arange(len(owner)), last], 0)
    for blocks, back in parts:
        now = last[blocks].copy()
        for t in range(len(back), -1, -1):
            live = np.searchsorted(-length[blocks], -t, "left")
            labels[start[blocks[:live]] + t] = now[:live]
            if t:
                now[:live] = back[t - 1][np.arange(live), entered[blocks[:live]], now[:live]]
    return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(texts: list[str], spans: list[list[tuple[int, int, int]]], epochs: int = 100, rate: float = 0.5, decay: float = 0.1) -> Field:
    """Likelihood ascent with forward-backward sums over all lines at once. spans: label, start and end (bytes) in each text."""
    data, offsets = utf8(pa.array(texts, pa.string()))
    row, start, end = words(data, offsets)
    truth = np.zeros(len(row), np.int64)
    for r, own in enumerate(spans):
        for label, a, b in own:
            truth[(row == r) & (start < offsets[r] + b) & (end > offsets[r] + a)] = label
    features, n = _features(data, start, end, row), len(LABELS)
    field = Field(np.zeros((FEATURE_BINS, n)), np.zeros((n, n)), np.zeros(n))
    past = [np.full(x.shape, 1e-6) for x in (field.emit, field.step, field.first)]
    starts, lengths, reach = _ordered(row)
    one = np.eye(n)
    for _ in range(epochs):
        scores = field.emit[features].sum(axis=1)
        forward, backward = np.zeros(scores.shape), np.zeros(scores.shape)
        forward[starts] = scores[starts] + field.first
        for t in range(1, len(reach)):
            at = starts[: reach[t]] + t
            forward[at] = _log_sum(forward[at - 1][:, :, None] + field.step, 1) + scores[at]
        for t in range(len(reach) - 1, 0, -1):
            at = starts[: reach[t]] + t
            backward[at - 1] = _log_sum(field.step[None] + (scores[at] + backward[at])[:, None, :], 2)
        whole = np.zeros(len(row))
        ends = starts + lengths - 1
        for s, total in zip(starts, _log_sum(forward[ends], 1), strict=True):
            whole[s] = total
        whole = whole[starts[np.argsort(starts)]][np.cumsum(np.concatenate(([0], (row[1:] != row[:-1]).astype(int))))]
        alike = np.exp(forward + backward - whole[:, None])
        inner = np.flatnonzero(np.concatenate(([False], row[1:] == row[:-1])))
        pairs = np.exp(forward[inner - 1][:, :, None] + field.step + (scores[inner] + backward[inner])[:, None, :] - whole[inner][:, None, None]).sum(axis=0)
        seen = np.zeros((n, n))
        np.add.at(seen, (truth[inner - 1], truth[inner]), 1)
        gap = one[truth] - alike
        emit = np.zeros_like(field.emit)
        for k in range(FEATURES):
            np.add.at(emit, features[:, k], gap)
        for i, (weights, grad) in enumerate(((field.emit, emit), (field.step, seen - pairs), (field.first, gap[starts].sum(axis=0)))):
            grad = grad - decay * weights
            past[i] += grad**2
            weights += rate * grad / np.sqrt(past[i]) * (grad != 0)
    return field


def labelled_table(rows: int = 800, seed: int = 7) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """The small labelled table: lines of made-up words with made-up personal data, and its label, start and end in bytes."""
    random = np.random.default_rng(seed)
    pick = lambda letters, a, b: "".join(random.choice(list(letters), int(random.integers(a, b + 1))))
    low, hexes, caps, nums = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789"

    def word() -> str:
        w = pick(low, 1, 12)
        w = (w, w.capitalize(), w.upper())[int(random.choice(3, p=[0.82, 0.13, 0.05]))]
        if random.random() < 0.04:
            w = str(random.choice(["2.0.", pick(nums, 1, 5), "3.", "4.0", f"{pick(nums, 1, 2)}%", "CC", "BY-NC", f"{w}-{pick(low, 2, 6)}", "|", f"http://{w}.org/{pick(low, 2, 8)}", "=", f"({w})"]))
        return w + str(random.choice(["", ",", ".", "!!", "%%%", "&&&", "###", "***", "$$$"], p=[0.72, 0.06, 0.08, 0.03, 0.03, 0.02, 0.02, 0.02, 0.02]))

    one = lambda *options: str(random.choice(options))

    def clean() -> str:
        """What looks like an item and is none: links, paths, code, sums, catalogue numbers, versions, dates, lists of numbers."""
        name = lambda: pick(low, 2, 9)
        number = lambda n: pick(nums, 1, n)
        kind = int(random.integers(0, 13))
        if kind == 0:
            return one("", "(", "[") + one("http", "https") + f"://{name()}.{name()}.{one('com', 'org', 'io')}/{name()}/{name()}" + one("", f"-{number(4)}.html", f"#{name()}-{name()}", f"?{name()}={number(3)}&{name()}={name()}", "/)")
        if kind == 1:
            return f"[{name().capitalize()}](" + one(f"https://{name()}.{name()}.org/{name()}", f"#{name()}-{name()}-{name()}") + ")"
        if kind == 2:
            return one("./", "/", "") + f"{name()}/{name()}_{name()}/{name()}." + one("py", "md", "json", "txt", "cc")
        if kind == 3:
            return f"{name()}.{name()}({name()}" + one("", "='" + name() + "'", f"={number(3)}", ", ") + one(")", "))", ",")
        if kind == 4:
            return one("commit", "sha1", "sha256", "md5", "checksum", "revision", "digest") + one(" ", ": ", ":", "=") + pick(hexes, 32, 64)
        if kind == 5:
            return one("ISBN ", "ISBN: ", "ISBN-13 ") + f"978-{number(1)}-{pick(nums, 2, 5)}-{pick(nums, 3, 6)}-{number(1)}"
        if kind == 6:
            return one("", "v", ">=", "==", "~=") + f"{number(2)}.{number(2)}.{number(2)}" + one("", "rc1", ".dev0", "-beta")
        if kind == 7:
            return one(f"20{pick(nums, 2, 2)}-0{number(1)}-{pick(nums, 2, 2)}", f"{pick(nums, 2, 2)}:{pick(nums, 2, 2)}:{pick(nums, 2, 2)}", f"20{pick(nums, 2, 2)}-1{number(1)}-{pick(nums, 2, 2)}T{pick(nums, 2, 2)}:{pick(nums, 2, 2)}:{pick(nums, 2, 2)}Z")
        if kind == 8:
            return ", ".join(pick(nums, 1, 5) for _ in range(int(random.integers(2, 6))))
        if kind == 9:
            return f"{name()}-{name()}" + one("", f"-{name()}")
        if kind == 10:
            return f"{name()}{name().capitalize()}{name().capitalize()}" + one("", "Error", f".{name()}", f"<{name().capitalize()}>")
        if kind == 11:
            return f"{name()}_{name()}" + one("=", " = ", "=='") + one("True", "None", number(5), f"0x{pick(hexes, 2, 8)}", f"{number(2)}.{number(3)}")
        return one(f"#{number(4)}", f"({name()}", f"{name()})", f"${number(3)}.{pick(nums, 2, 2)}", f"@{name()}", f"@{name()}/{name()}", f"No. {number(6)}", f"{number(3)}x{number(3)}")

    def item() -> tuple[int, str]:
        kind = int(random.integers(1, 10))
        if kind == 1:
            return 1, f"{pick(low, 3, 10)}.{pick(nums, 1, 2)}@" + one(f"mail{pick(nums, 1, 1)}.example.com", f"{pick(low, 3, 8)}.{pick(low, 2, 3)}")
        if kind == 2:
            return 2, ".".join(str(int(x)) for x in random.integers(1, 255, 4))
        if kind == 3:
            return 3, one("4" + pick(nums, 15, 15), "-".join(pick(nums, 4, 4) for _ in range(4)))
        if kind == 4:
            return 4, one(f"+1 ({pick(nums, 3, 3)}) 555-{pick(nums, 4, 4)}", f"+{pick(nums, 2, 2)} {pick(nums, 2, 3)} {pick(nums, 3, 4)} {pick(nums, 3, 4)}")
        if kind == 5:
            return 5, f'token = "{pick(hexes, 40, 40)}"'
        if kind == 6:
            return 5, f"password={pick(hexes, 18, 18)}"
        if kind == 7:
            return 5, "AKIA" + pick(caps, 16, 16)
        if kind == 8:
            quote, value = one("", '"', "'"), pick(str(random.choice([hexes, caps, low + caps, low + caps + "+/"])), 14, 48)
            name = one("", f"{pick(low, 2, 6)}_") + one("api_key", "secret", "passwd", "auth_token", "key")
            return 5, one(name, name.upper()) + one("=", ": ", " = ") + quote + value + quote
        return 5, one(pick(low, 2, 4) + one("-", "_"), "") + pick(low + caps, 24, 60)

    texts, spans = [], []
    for _ in range(rows):
        parts, own, size = [], [], 0
        for _ in range(int(random.integers(3, 20))):
            draw = random.random()
            label, part = item() if draw < 0.12 else (0, clean()) if draw < 0.27 else (0, word())
            if label:
                own.append((label, size, size + len(part)))
                part += str(random.choice(["", ".", ",", "###", "%%%", "!!"], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05]))
            parts.append(part)
            size += len(part.encode()) + 1
        texts.append(" ".join(parts))
        spans.append(own)
    return texts, spans


_EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())


def field_spans(field: Field, text: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Kind's number, start and end (code points) of the runs of words that the field labels alike, without signs at their edges."""
    data, offsets = utf8(text)
    row, start, end = words(data, offsets)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(text))]
    if not len(row):
        return out
    # a line ends at a line feed
    breaks = np.concatenate(([0], np.cumsum(data == 10)))[start]
    line = np.cumsum(np.concatenate(([True], (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1]))))
    features = _features(data, start, end, line)
    scores = np.zeros((len(row), len(LABELS)), np.float32)
    emit = field.emit.astype(np.float32)
    for k in range(FEATURES):
        scores += emit[features[:, k]]
    labels = viterbi(field, scores, line)
    marked = np.flatnonzero(labels)
    if not len(marked):
        return out
    first = np.concatenate(([True], (np.diff(marked) != 1) | (labels[marked][1:] != labels[marked][:-1]) | (line[marked][1:] != line[marked][:-1])))
    heads = np.flatnonzero(first)
    for a, b in zip(marked[heads], marked[np.append(heads[1:], len(marked)) - 1], strict=True):
        r = int(row[a])
        piece = data[start[a] : end[b]].tobytes().decode()
        core = piece.strip(_EDGE)
        if core:
            ahead = len(data[offsets[r] : start[a]].tobytes().decode()) + piece.index(core)
            out[r].append((int(labels[a]) - 1, ahead, ahead + len(core)))
    return out


_CARD_FORMS = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")
_PHONE_FORMS = re.compile(r"(?<![\w.])\+?[(]?[0-9][0-9 ().-]*[0-9](?![\w])")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}")
_NAMED = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)[a-z_]*[\"']?\s*[=:]\s*[\"']?([^\s\"']{8,})")
_KEY = re.compile(r"[A-Za-z0-9+=_-]{12,}")
_ISSUED = re.compile(r"(?<![A-Z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Z0-9])")
_SUM_BEFORE = re.compile(r"(?i)(?:commit|rev(?:ision)?|sha-?[0-9]*|md5|checksum|digest|hash(?:es)?)[\s:=\"'(]*\Z")


def plausible(kind: int, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """The spans within a labelled run that can be of its kind: an address has an @, numbers have their digits, a secret is named
    as one or mixes letters and digits as no word, link or path does."""
    piece = text[start:end]
    if KINDS[kind] == "email":
        return [(kind, start, end)] if "@" in piece.strip("@") and " " not in piece else []
    if KINDS[kind] == "ip":
        return [(kind, start + m.start(), start + m.end()) for m in re.finditer(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w.])", piece)]
    if KINDS[kind] == "card":
        return [(kind, start + m.start(), start + m.end()) for m in _CARD_FORMS.finditer(piece)]
    if KINDS[kind] == "phone":
        forms = [m for m in _PHONE_FORMS.finditer(piece) if 9 <= sum(c.isdigit() for c in m[0]) <= 15 and not m[0].isdigit() and not _DATE.search(m[0]) and not re.search(r"^[0-9.]+$| {2}", m[0])]
        return [(kind, start + m.start(), start + m.end()) for m in forms]
    if "://" in piece or "](" in piece:
        return []
    if (named := _NAMED.search(piece)) and any(c.isdigit() for c in named[1]):
        return [(kind, start, end)]
    if _ISSUED.search(piece):
        return [(kind, start, end)]
    if re.fullmatch("[0-9a-f]+", piece) and _SUM_BEFORE.search(text[max(0, start - 16) : start]):
        return []
    for m in _KEY.finditer(piece):
        digits, letters = sum(c.isdigit() for c in m[0]), sum(c.isalpha() for c in m[0])
        # letters and digits alternate more often in keys than in words with a number behind them
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(m[0], m[0][1:], strict=False))
        cases = sum(a.isupper() != b.isupper() for a, b in zip(m[0], m[0][1:], strict=False))
        if (digits >= 3 and letters >= 3 and turns >= 4) or (len(m[0]) >= 20 and 3 * (cases + turns) >= len(m[0])):
            return [(kind, start, end)]
    return []


def _added(base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """base and those found that overlap none of base, by kind and start."""
    taken = sorted((a, b) for _, a, b in base)
    edges = np.array([a for a, _ in taken]), np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
    free = [s for s in found if not (i := int(np.searchsorted(edges[0], s[2]))) or edges[1][i - 1] <= s[1]]
    return sorted(base + free)


def _finder(shared, name: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            text = batch.column("text")
            more = field_spans(shared.value, text)
            lists = []
            for t, found in zip(text.to_pylist(), more, strict=True):
                base = base_spans(t)
                found = [s for k, a, b in found for s in plausible(k, t, a, b)]
                mine = {(k, a) for k, a, _ in base}
                lists.append([{"kind": KINDS[k], "start": a, "end": b, "base": (k, a) in mine} for k, a, b in _added(base, found)])
            spans = pa.array(lists, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], [*batch.schema.names, name])

    return find


def find(docs: DataFrame, field: Field | None = None, name: str = "spans") -> DataFrame:
    """docs with `spans`: kind, start, end, and whether a pattern found it. Null text becomes empty; a column of that name is replaced."""
    rows = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(field or train(*labelled_table()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_finder(shared, name), f"{schema}, `{name}` array<struct<kind: string, start: long, end: long, base: boolean>>")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with each span's text replaced by its kind in brackets; where spans overlap, the first one's. Null text becomes empty.

    n_chars follows the text. Only the text goes to Python and back with the other columns under names of their own, so that docs may have any.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    chars = names[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                parts, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                    at = max(at, s["end"])
                texts.append("".join(parts) + t[at:])
            k = batch.schema.get_field_index("text")
            out = batch.set_column(k, pa.field("text", pa.string()), pa.array(texts, pa.string()))
            if chars and (c := out.schema.get_field_index(chars)) >= 0:
                out = out.set_column(c, out.schema.field(c), pa.array(map(len, texts), out.schema.field(c).type))
            yield out.drop_columns(["spans"])

    finder = _finder(docs.sparkSession.sparkContext.broadcast(field or train(*labelled_table())), "spans")
    rows = rows.withColumnRenamed(text, "text")
    return rows.mapInArrow(lambda batches: replace(finder(batches)), rows.schema).toDF(*docs.columns)


def _joined(spans: Column, keep=lambda s: F.lit(True)) -> Column:
    text = F.transform(F.filter(spans, keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def op7_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(_joined(spans, lambda s: s["base"]), 256).alias("base_sha256"), _joined(spans).alias("spans"))
