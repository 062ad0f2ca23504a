"""Statistics of whole texts, in numpy over many texts at once, transformed towards normal shape."""

from __future__ import annotations

import numpy as np

#: Texts are taken in blocks of about so many bytes, to bound memory; longer ones in pieces.
BLOCK_BYTES = 1_000_000
NAMES = ("words", "word_length", "word_length_spread", "line_words", "short_words", "long_words", "new_words", "new_pairs", "top_word", "upper", "upper_words", "digits", "stops", "bangs", "symbols", "bare_symbols", "wide_bytes", "entropy")

_SPACE, _UPPER, _LOWER, _DIGIT, _WIDE, _STOP, _BANG, _SYMBOL = range(8)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _WIDE
_CLASS[list(b".,;:'\"-()")] = _STOP
_CLASS[list(b"!?")] = _BANG
_LETTER = np.isin(np.arange(8), (_UPPER, _LOWER, _DIGIT, _WIDE))


def pieces(raw: bytes):
    """A text in parts of at most BLOCK_BYTES that begin at white space, so that no word is cut unless it is longer."""
    while len(raw) > BLOCK_BYTES:
        spaces = np.flatnonzero(_CLASS[np.frombuffer(raw[:BLOCK_BYTES], np.uint8)] == _SPACE)
        end = int(spaces[-1]) if len(spaces) and spaces[-1] else BLOCK_BYTES
        yield raw[:end]
        raw = raw[end:]
    yield raw


def blocks(texts):
    """Lists of (text number, UTF-8 piece) of at most about BLOCK_BYTES together; None counts as empty."""
    got, size = [], 0
    for k, text in enumerate(texts):
        for piece in pieces((text or "").encode()):
            if got and size + len(piece) > BLOCK_BYTES:
                yield got
                got, size = [], 0
            got.append((k, piece))
            size += len(piece)
    if got:
        yield got


def _share(part, whole, floor=0.5):
    """Log of a share, with pseudo-counts so that none is 0 or 1."""
    return np.log((part + floor) / (whole + 2 * floor))


def _measure(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per piece what adds up over the pieces of a text (8 classes, 256 bytes, then sums over words); the hash of every
    word of all pieces, and the piece it is in."""
    n = len(block)
    raw = np.frombuffer(b" ".join(block) + b" ", np.uint8)
    ends = np.cumsum([len(b) + 1 for b in block])
    doc = np.repeat(np.arange(n), np.diff(ends, prepend=0))
    kind = _CLASS[raw]
    classes = np.bincount(doc * 8 + kind, minlength=8 * n).reshape(n, 8)
    each = np.bincount(doc * 256 + raw, minlength=256 * n).reshape(n, 256)
    classes[:, _SPACE] -= 1  # the space that was added behind each piece
    each[:, 32] -= 1
    # words are runs of anything but white space
    inside = kind != _SPACE
    first = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    last = np.flatnonzero(inside & ~np.r_[inside[1:], False])
    own, length = doc[first], last - first + 1
    letters, upper = np.r_[0, np.cumsum(_LETTER[kind])], np.r_[0, np.cumsum(kind == _UPPER)]
    n_letters, n_upper = letters[last + 1] - letters[first], upper[last + 1] - upper[first]
    sums = [np.bincount(own, v, minlength=n) for v in (np.ones(len(own)), length, length**2, length <= 3, length >= 12, (n_upper == n_letters) & (n_letters > 1), n_letters == 0)]
    # polynomial hash of each word's bytes
    at = np.cumsum(length) - length
    place = np.arange(length.sum()) - np.repeat(at, length)
    code = raw[inside].astype(np.uint64) * _POWERS[np.minimum(place, len(_POWERS) - 1)]
    word = np.add.reduceat(code, at) if len(at) else np.zeros(0, np.uint64)
    return np.column_stack([classes, each, *sums]), word, own


def _finish(sums: np.ndarray, word: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Transformed statistics of texts from their sums and words."""
    n = len(sums)
    counts, each = sums[:, :8], sums[:, 8:264]
    words, total, squares, short, long, shouted, bare = sums[:, 264:].T
    size = counts.sum(1)
    share = each / np.maximum(1, size)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    mean = total / np.maximum(1, words)
    spread = np.sqrt(np.maximum(0, squares / np.maximum(1, words) - mean**2))
    together = own[:-1] == own[1:]
    pair = (word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])[together]
    new, top = _distinct(word, own, n)
    new_pairs, _ = _distinct(pair, own[:-1][together], n)
    pairs = np.maximum(0, words - 1)
    return np.stack(
        [
            np.log1p(words),
            np.log1p(mean),
            np.log1p(spread),
            np.log((words + 1) / (each[:, 10] + 1)),
            _share(short, words),
            _share(long, words),
            _share(new, words),
            _share(pairs - new_pairs, pairs),
            _share(top, words),
            _share(counts[:, _UPPER], size),
            _share(shouted, words),
            _share(counts[:, _DIGIT], size),
            _share(counts[:, _STOP], size),
            _share(counts[:, _BANG], size),
            _share(counts[:, _SYMBOL], size),
            _share(bare, words),
            _share(counts[:, _WIDE], size),
            entropy,
        ],
        axis=1,
    )


def statistics(texts) -> np.ndarray:
    """Rows of transformed statistics, one per text, in the order of NAMES; an empty text has finite values too.

    Of a long text, only the sums of its pieces and a hash of each word are held together.
    """
    out, at, held = [np.zeros((0, len(NAMES)))], None, []

    def whole():
        sums, words = zip(*held, strict=True)
        return _finish(np.sum(sums, axis=0)[None], np.concatenate(words), np.zeros(sum(map(len, words)), np.int64))

    for block in blocks(texts):
        sums, word, own = _measure([piece for _, piece in block])
        text = np.array([k for k, _ in block])
        # the first text may go on from the last block, and the last may go on in the next one
        if held and text[0] != at:
            out.append(whole())
            held = []
        head = 0
        if held:
            held.append((sums[0], word[own == 0]))
            head = 1
            if len(block) > 1:
                out.append(whole())
                held = []
        if head < len(block):
            tail = len(block) - 1
            middle = (own >= head) & (own < tail)
            if tail > head:
                out.append(_finish(sums[head:tail], word[middle], own[middle] - head))
            held = [(sums[tail], word[own == tail])]
        at = text[-1]
    if held:
        out.append(whole())
    return np.concatenate(out)


_POWERS = np.array([pow(0x100000001B3, k, 1 << 64) for k in range(256)], np.uint64)


def _distinct(codes: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, occurrences of the commonest) of each text; codes are told apart by their high bits and text."""
    if not len(codes):
        return np.zeros(n), np.zeros(n)
    bits = max(1, n - 1).bit_length()
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    key = np.sort((own.astype(np.uint64) << np.uint64(64 - bits)) | (mixed >> np.uint64(bits)))
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    text = (key[starts] >> np.uint64(64 - bits)).astype(np.int64)
    run = np.diff(np.r_[starts, len(key)])
    top = np.zeros(n)
    np.maximum.at(top, text, run)
    return np.bincount(text, minlength=n).astype(float), top
