"""Token ids of whole texts by a public tokenizer whose pre-tokens never cross white space.

Each distinct word is encoded once for a worker and batch; a text's ids are those of its words in
order. A full stop or comma after an ASCII letter is a word of its own, and words of plain ASCII
letters count as lower case, as the tokenizer's own normaliser makes them; both leave the ids as they are.
"""

from __future__ import annotations

import numpy as np

from .common import factorize, kept, key_hash, spans, word_keys

_LIMIT = 1_000_000
_RECENT = 1 << 17


class _Cache:
    """Words by hash, in sorted arrays, and by place their whole keys: some 50 bytes a word. New words gather in a small array that is merged now and then.

    A word whose hash another one holds already is not found, and so encoded again.
    """

    def __init__(self):
        self.keys = [np.zeros(0, np.uint64)] * 2
        self.places = [np.zeros(0, np.int32)] * 2
        self.cut, self.ids, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 17, np.uint32), 0
        self.whole = np.zeros((1 << 16, 2), np.uint64)

    def find(self, keys: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Places of words with sorted hashes, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        for own, places in zip(self.keys, self.places, strict=True):
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = np.flatnonzero(own[at] == keys)
                hit = hit[(self.whole[places[at[hit]]] == whole[hit]).all(1)]
                out[hit] = places[at[hit]]
        return out

    def add(self, keys: np.ndarray, whole: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of new words with sorted hashes."""
        end = self.cut[self.n]
        while len(self.cut) <= self.n + len(keys):
            self.cut = np.concatenate([self.cut, np.zeros_like(self.cut)])
            self.whole = np.concatenate([self.whole, np.zeros_like(self.whole)])
        while len(self.ids) < end + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[end : end + len(ids)] = ids
        self.cut[self.n + 1 : self.n + 1 + len(keys)] = end + np.cumsum(sizes)
        places = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.whole[places] = whole
        self.n += len(keys)
        level = 1 if len(self.keys[1]) + len(keys) < _RECENT else 0
        parts = [self.keys[1], keys] if level else [*self.keys, keys]
        both = np.concatenate(parts)
        order = np.argsort(both, kind="stable")
        spots = np.concatenate([self.places[1], places] if level else [*self.places, places])
        self.keys[level], self.places[level] = both[order], spots[order]
        if not level:
            self.keys[1], self.places[1] = self.keys[1][:0], self.places[1][:0]
        return places


def _tables(path: str) -> tuple:
    state = kept.setdefault("tokens", {})
    if state.get("path") != path:
        from tokenizers import Tokenizer

        state.update(path=path, tokenizer=Tokenizer.from_file(path), cache=_Cache())
    if state["cache"].n > _LIMIT:
        state["cache"] = _Cache()
    return state["tokenizer"], state["cache"]


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and two-part key of the spans that are encoded by themselves."""
    starts, ends = spans(data, offsets)
    odd = np.append(0, np.cumsum((data >= 128) | (data == ord("|")), dtype=np.int64))
    plain = odd[ends] == odd[starts]
    last = data[ends - 1]
    before = data[np.maximum(ends - 2, 0)] | 32
    cut = plain & (ends - starts > 1) & ((last == ord(".")) | (last == ord(","))) & (before >= 97) & (before <= 122)
    order = np.argsort(np.concatenate([starts, ends[cut] - 1]), kind="stable")
    starts, ends, plain = np.concatenate([starts, ends[cut] - 1])[order], np.concatenate([ends - cut, ends[cut]])[order], np.concatenate([plain, plain[cut]])[order]
    lo, hi = word_keys(data, starts, ends)
    odd = np.flatnonzero(~plain)
    lo[odd], exact = word_keys(data, starts[odd], ends[odd], lower=False)
    hi[odd] = exact ^ np.uint64(0x40 << 56)  # no key of plain words has this bit like this
    return starts, ends, lo, hi


def _encode_words(tokenizer, texts: list[str], run: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids, and the ids one after another. Words go in runs, parted by a bar that no word holds."""
    bar = tokenizer.token_to_id("|</w>")
    sizes, parts = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)] * len(texts)
    plain = [i for i, x in enumerate(texts) if "|" not in x] if bar is not None else []
    runs = [plain[a : a + run] for a in range(0, len(plain), run)]
    rest = set(range(len(texts))).difference(plain)
    for mine, e in zip(runs, tokenizer.encode_batch_fast([" | ".join([texts[i] for i in r]) for r in runs], add_special_tokens=False), strict=True):
        got = np.array(e.ids, np.uint32)
        at = np.flatnonzero(got == bar)
        if len(at) != len(mine) - 1:
            rest.update(mine)
            continue
        begin, end = np.append(0, at + 1), np.append(at, len(got))
        sizes[mine] = end - begin
        for i, a, b in zip(mine, begin.tolist(), end.tolist(), strict=True):
            parts[i] = got[a:b]
    single = sorted(rest)
    for i, e in zip(single, tokenizer.encode_batch_fast([texts[i] for i in single], add_special_tokens=False), strict=True):
        parts[i] = np.array(e.ids, np.uint32)
        sizes[i] = len(parts[i])
    return sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def encode(path: str, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of concatenated texts, and where each text's ids begin; ``end_id`` closes each text."""
    starts, ends, lo, hi = subwords(data, offsets)
    code, first = factorize(lo, hi)
    tokenizer, cache = _tables(path)
    whole = np.stack([lo[first], hi[first]], 1)
    keys = key_hash(whole[:, 0], whole[:, 1])
    order = np.argsort(keys, kind="stable")
    at = cache.find(keys[order], whole[order])
    new = np.flatnonzero(at < 0)
    if len(new):
        raw = data.tobytes()
        begin, stop = starts[first[order[new]]].tolist(), ends[first[order[new]]].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin, stop, strict=True)]
        at[new] = cache.add(keys[order[new]], whole[order[new]], *_encode_words(tokenizer, texts))
    spot = np.empty(len(first), np.int64)
    spot[order] = at
    spot = spot[code]
    begin = cache.cut[spot]
    size, pool, close = cache.cut[spot + 1] - begin, cache.ids, 0 if end_id is None else 1
    owner = np.searchsorted(offsets, starts, "right") - 1  # an empty text shares its offset with the next one
    per = np.bincount(owner, weights=size, minlength=len(offsets) - 1).astype(np.int64) if len(size) else np.zeros(len(offsets) - 1, np.int64)
    text_cut = np.append(0, np.cumsum(per + close))
    out = np.full(text_cut[-1], end_id or 0, np.uint32)
    total = np.cumsum(size)
    where = np.arange(int(total[-1]) if len(total) else 0)
    source = np.repeat(begin - (total - size), size) + where
    out[where + close * np.repeat(owner, size)] = pool[source]
    return out, text_cut
