"""An n-gram trie of one shard: Elias-Fano levels of word numbers, monotone pointers, quantised smoothed probabilities."""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np

from flowlens.llm.elias_fano import EliasFano

STEP = 2048  # quantised logarithms: 0 to -32 by 1 / STEP
#: In the place of the earlier word: the row counts a pair of words, for a middle word whose rows are dealt out by the
#: earlier. It is the number of a text's end, which no word follows.
ANY = 2


def quantised(p: np.ndarray) -> np.ndarray:
    q = np.log10(p)
    q *= -STEP
    np.rint(q, out=q)
    return np.clip(q, 0, 65535, out=q).astype("<u2")


def logs(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64) / -STEP


def chained(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rising lists, one after another, as one strictly rising sequence: each begins above the last value of the one before."""
    last = values[starts + sizes - 1] + 1 if len(starts) else values[:0]
    base = np.cumsum(last) - last
    return values + 1 + np.repeat(base, sizes)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of stretches of equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows ``(v, u, w, n)`` sorted, those of equal words as one. Empties ``parts``: each copy of a shard's rows counts."""
    v, u, w, n = parts[0] if len(parts) == 1 else (np.concatenate([p[i] for p in parts]) for i in range(4))
    parts.clear()
    middles, kinds = np.unique(v), (u.dtype, w.dtype)
    bits_u, bits_w = (int(x.max(initial=0)).bit_length() for x in (u, w))
    if len(middles).bit_length() + bits_u + bits_w > 63:
        order = np.lexsort((w, u, v))
        v, u, w, n = v[order], u[order], w[order], n[order]
        starts, _ = runs(v, u, w)
        return v[starts], u[starts], w[starts], summed(n, starts)
    keys = np.searchsorted(middles, v)
    del v
    for bits, x in ((bits_u, u), (bits_w, w)):
        keys <<= bits
        keys |= x.astype(np.int64, copy=False)
    del u, w, x
    if (n == 1).all():
        keys.sort()
        starts, n = runs(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        del order
        starts, _ = runs(keys)
        n = summed(n, starts)
    keys = keys[starts]
    u, w = keys >> bits_w & (1 << bits_u) - 1, keys & (1 << bits_w) - 1
    return middles[keys >> bits_u + bits_w], u.astype(kinds[0], copy=False), w.astype(kinds[1], copy=False), n


def summed(n: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(n, starts, dtype=np.int64) if len(starts) else n.astype(np.int64)


@dataclass
class Trie:
    """Middle words ``v``; of each its next words ``next_`` (with the probability after ``v``) and its earlier words ``before``;
    of each (earlier, middle) the places ``then`` of its next words among those of ``v`` (with the probability after both).
    ``off_*`` are the weights with which shorter contexts go on. Pointers are the first places of each list, monotone; the
    lists of middle words lie ``stride`` apart, those of contexts as near as they can."""

    middle: EliasFano
    next_: EliasFano
    before: EliasFano
    then: EliasFano
    to_next: EliasFano
    to_then: EliasFano
    p_next: np.ndarray
    p_then: np.ndarray
    off_middle: np.ndarray
    off_before: np.ndarray
    stride: int

    @classmethod
    def of(cls, v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, alone: Callable, discount: float) -> Trie:
        """From sorted rows ``(v, u, w, n)`` and the probability of each word ``alone``, by interpolated absolute
        discounting: p(w | context) = (n - discount) / N + discount * kinds / N * p(w | shorter context)."""
        whole = u == ANY
        vs, us, ws, ns = v, u, w, n
        parts = [(v, w, w, n)]
        if whole.any():
            vs, us, ws, ns = (x[~whole] for x in (v, u, w, n))
            own = ~np.isin(vs, v[whole])
            parts = [(vs[own], ws[own], ws[own], ns[own]), (v[whole], w[whole], w[whole], n[whole])]
        stride = int(max(w.max(initial=0), u.max(initial=0))) + 1
        del v, u, w, n, whole
        pv, pw, _, pn = merged(parts)
        at, size = runs(pv)
        middles = pv[at]
        total = np.add.reduceat(pn, at) if len(at) else pn
        off_middle = discount * size / np.maximum(1, total)
        p_next = (pn - discount) / np.repeat(total, size) + np.repeat(off_middle, size) * alone(pw)
        pairs_at = np.repeat(np.arange(len(at)), size) * stride + pw
        next_ = EliasFano.of(pairs_at)
        n_pairs = len(pw)
        del pv, pw, pn, total, size
        # the earlier words of each middle word, then the next words of both as places among those of the middle word
        bat, bsize = runs(vs, us)
        bv, bu, n_rows = vs[bat], us[bat], len(ws)
        m = np.searchsorted(middles, vs)
        del vs, us
        first = at[m]
        m *= stride
        m += ws
        del ws
        index = np.searchsorted(pairs_at, m)
        del m, pairs_at
        btotal = np.add.reduceat(ns, bat) if len(bat) else ns
        off_before = discount * bsize / np.maximum(1, btotal)
        p_then = ns - discount
        p_then /= np.repeat(btotal, bsize)
        shorter = np.repeat(off_before, bsize)
        shorter *= p_next[index]
        p_then += shorter
        del ns, shorter
        p_then, p_next = quantised(p_then), quantised(p_next)
        index -= first
        del first
        then = EliasFano.of(chained(index, bat, bsize))
        del index
        pointers = [EliasFano.of(np.append(x, n)) for x, n in ((at, n_pairs), (bat, n_rows))]
        return cls(
            EliasFano.of(middles), next_, EliasFano.of(np.searchsorted(middles, bv) * stride + bu), then, *pointers,
            p_next, p_then, quantised(off_middle), quantised(off_before), stride,
        )

    def mapped(self) -> Trie:
        """The same levels in a file without a name, mapped into memory: pages come and go with use, and nothing is left."""
        with tempfile.TemporaryFile() as file:
            placed, at = {}, 0
            for name, array in self.arrays():
                data = np.ascontiguousarray(array)
                at += file.write(b"\0" * (-at % 8))
                placed[name] = at, data.dtype, len(data)
                at += file.write(data.data) if len(data) else 0
            file.write(b"\0" * 8)
            file.flush()
            levels = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        got = {k: np.frombuffer(levels, d, n, offset) for k, (offset, d, n) in placed.items()}
        made = {}
        for f in fields(self):
            x = getattr(self, f.name)
            if isinstance(x, EliasFano):
                made[f.name] = EliasFano(x.n, x.width, *[got[f"{f.name}.{i}"] for i in range(3)])
            else:
                made[f.name] = got.get(f.name, x)
        return Trie(**made)

    def arrays(self) -> list[tuple[str, np.ndarray]]:
        out = []
        for f in fields(self):
            x = getattr(self, f.name)
            if isinstance(x, EliasFano):
                out += [(f"{f.name}.{i}", a) for i, a in enumerate(x.parts())]
            elif isinstance(x, np.ndarray):
                out.append((f.name, x))
        return out

    def following(self, context: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place ``x`` of a middle word's list among what follows each context: where it is, and whether it is there."""
        start, stop = self.to_then.access(context), self.to_then.access(context + 1)
        base = np.zeros(len(x), np.int64)
        base[start > 0] = self.then.access(start[start > 0] - 1)
        place, found = self.then.successor(base + x + 1)
        return place, found & (place < stop)

    def score(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, p_word: np.ndarray) -> np.ndarray:
        """log10 p(w | u v) of each row; ``p_word`` is the probability of ``w`` alone."""
        out = np.log10(p_word)
        if not self.middle.n:
            return out
        order = np.argsort(v << 32 | u)  # neighbours read the same places
        out[order] = self.told(u[order], v[order], w[order], out[order])
        return out

    def told(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, out: np.ndarray) -> np.ndarray:
        middle, known = self.middle.successor(v)
        rows = np.flatnonzero(known)
        u, w, middle = u[rows], w[rows], middle[rows]
        place, pair = self.next_.successor(middle * self.stride + w)
        pair &= w < self.stride  # a greater number is of another list
        told = out[rows] + logs(self.off_middle[middle])
        told[pair] = logs(self.p_next[place[pair]])
        before, context = self.before.successor(middle * self.stride + u)
        context &= u < self.stride
        # the next word counts from the start of the middle word's list
        both = np.flatnonzero(context & pair)
        then, triple = self.following(before[both], place[both] - self.to_next.access(middle[both]))
        told[context] += logs(self.off_before[before[context]])
        told[both[triple]] = logs(self.p_then[then[triple]])
        out[rows] = told
        return out
