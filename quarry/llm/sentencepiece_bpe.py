"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is split into units, a run of spaces and what follows it, because no piece has a space after another
character; each distinct unit is encoded once. All new units of a slice are merged together: flat arrays hold
their symbols, a segmented minimum finds each unit's best pair, and the leftmost occurrences merge at once; units
with no pair left are taken out, the rest is compacted, until none remains.

A round costs what is left of all units, so units of more than LONG symbols take rounds of their own that touch live
pairs only: their symbols are linked lists in arrays, and the places of all pairs lie in buckets by rank. A round takes
the bucket of the least rank, merges its places in all long units and puts the pairs that arise into their buckets.

Several occurrences merge in one round only where that is exact: a piece is "calm" if no piece that has it as a part
ranks before it, so that no merge beside one occurrence can come before the next occurrence. Of another piece only
the leftmost occurrence of a unit merges in a round.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TextSlice, distinct, per_text
from .units import UnitCache

SPACE_MARK = "▁"
NONE = np.int64(1 << 40)
#: Symbols of a unit beyond which it takes rounds over live pairs.
LONG = 256
_UNIT = re.compile(r" *[^ ]+| +")
_loaded: dict[str, PieceModel] = {}


class PieceModel:
    """The pieces of a BPE model and its merges as sorted arrays."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        for probe in ("a  b", " a ", "Ａ "):
            if sp.normalize(probe) != SPACE_MARK + probe.replace(" ", SPACE_MARK):
                raise ValueError("only models with identity normalisation and a leading space are supported")
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {sp.id_to_piece(i): i for i in plain}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in ids):
            raise ValueError("a piece has a space after another character")
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        if (self.bytes == sp.unk_id()).any():
            raise ValueError("the model has no byte fallback")
        self.bos, self.eos, self.n = sp.bos_id(), sp.eos_id(), n
        # Characters that only occur inside pieces are symbols too; they come after all ids.
        symbols = dict(ids)
        for ch in sorted({c for p in ids for c in p} - set(ids)):
            symbols[ch] = n + len(symbols) - len(ids)
        self.width = np.int64(n + len(symbols) - len(ids) + 1)
        self.other = self.width - 1  # a character outside the model; merges with nothing
        self.chars = {c: i for c, i in symbols.items() if len(c) == 1}
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        rank = {i: order[sp.get_score(i)] for i in plain}
        keys, ranks, results, wild = [], [], [], set()
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is None or right is None:
                    continue
                keys.append(left * int(self.width) + right)
                ranks.append(rank[i])
                results.append(i)
                wild |= {x for x in (left, right) if x in rank and rank[x] >= rank[i]}
        by = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks, self.results = (np.array(x, np.int64)[by] for x in (keys, ranks, results))
        self.calm = np.ones(int(self.width), bool)
        self.calm[list(wild)] = False
        # Pieces of equal rank could take turns; they merge one at a time.
        spread = np.bincount(list(rank.values()))
        self.calm[[i for i in plain if spread[rank[i]] > 1]] = False
        self.units = UnitCache(lambda units: self.merge([SPACE_MARK + u.replace(" ", SPACE_MARK) for u in units]))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.results[at], -1)

    def merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and units + 1 offsets."""
        lens = np.fromiter(map(len, units), np.int64, len(units))
        text = "".join(units)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        known, back = np.unique(codes, return_inverse=True)
        sym = np.array([self.chars.get(chr(c), int(self.other)) for c in known], np.int64)[back]
        code, unit = codes.astype(np.int64), np.repeat(np.arange(len(units)), lens)
        done_sym, done_code, done_unit = [], [], []
        if (lens > LONG).any():
            long = np.repeat(lens > LONG, lens)
            for done, x in zip((done_sym, done_code, done_unit), self._merge_long(sym[long], code[long], unit[long]), strict=True):
                done.append(x)
            sym, code, unit = sym[~long], code[~long], unit[~long]
        rank, res = self._all_pairs(sym, unit)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.repeat(best, sizes)
            over = least == NONE
            if over.any():
                done_sym.append(sym[over])
                done_code.append(code[over])
                done_unit.append(unit[over])
                keep = ~over
                sym, code, unit, rank, res, least = (x[keep] for x in (sym, code, unit, rank, res, least))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            hu, piece = unit[hit], res[hit]
            new_unit = np.r_[True, hu[1:] != hu[:-1]]
            # Of a run of overlapping occurrences every second one merges, from its left end.
            run = new_unit | np.r_[True, np.diff(hit) > 1]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            take = ((np.arange(len(hit)) - begin) % 2 == 0) & (new_unit | self.calm[piece])
            at = hit[take]
            sym[at] = res[at]
            code[at] = -1
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, code, unit, rank, res = (x[keep] for x in (sym, code, unit, rank, res))
            near = distinct(np.r_[moved[at], np.maximum(moved[at] - 1, 0)])
            rank[near], res[near] = self._pairs_at(sym, unit, near)
        sym, code, unit = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_sym, done_code, done_unit))
        by = np.argsort(unit, kind="stable")
        return self._fall_back(sym[by], code[by], unit[by], len(units))

    def _merge_long(self, sym: np.ndarray, code: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols that are left of long units, by rounds over buckets of live pairs."""
        n = len(sym)
        end = np.flatnonzero(np.r_[unit[1:] != unit[:-1], True])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[end], before[np.r_[0, end[:-1] + 1]] = -1, -1
        rank, res = self._all_pairs(sym, unit)
        alive = np.ones(n, bool)
        buckets: dict[int, list[np.ndarray]] = {}
        least: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            own = rank[at]
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True) if len(at) else ():
                r = int(own[a])
                if r not in buckets:
                    buckets[r] = []
                    heapq.heappush(least, r)
                buckets[r].append(at[a:b])

        put(np.arange(n))
        while least:
            r = heapq.heappop(least)
            parts = buckets.pop(r)
            at = parts[0] if len(parts) == 1 else distinct(np.concatenate(parts))
            at = at[rank[at] == r]  # a pair that is gone has another rank or none
            if not len(at):
                continue
            rest = at[:0]
            if len(at) > 1:
                place, begin, new_unit = np.arange(len(at)), np.arange(len(at)), np.ones(len(at), bool)
                begin[1:][after[at[:-1]] == at[1:]] = 0
                new_unit[1:] = unit[at[1:]] != unit[at[:-1]]
                take = ((place - np.maximum.accumulate(begin)) % 2 == 0) & (new_unit | self.calm[res[at]])
                rest, at = at[~take], at[take]
            gone = after[at]
            sym[at], code[at] = res[at], -1
            alive[gone], rank[gone] = False, NONE
            after[at] = after[gone]
            follow = after[at]
            some = follow >= 0
            before[follow[some]] = at[some]
            near = np.concatenate([at, before[at]])
            near = distinct(near[near >= 0])
            follow = after[near]
            rank[near], res[near] = self.pairs(sym[near], sym[follow])
            rank[near[follow < 0]] = NONE
            put(distinct(np.concatenate([near, rest])) if len(rest) else near)
        return sym[alive], code[alive], unit[alive]

    def _pairs_at(self, sym: np.ndarray, unit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(at + 1, len(sym) - 1)
        rank, res = self.pairs(sym[at], sym[after])
        rank[(after == at) | (unit[after] != unit[at])] = NONE
        return rank, res

    def _all_pairs(self, sym: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._pairs_at(sym, unit, np.arange(len(sym))) if len(sym) else (sym, sym)

    def _fall_back(self, sym: np.ndarray, code: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the bytes of their character."""
        odd = sym >= self.n
        if odd.any():
            c = code[odd]
            size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            raw = "".join(map(chr, c)).encode("utf-8")
            reps = np.ones(len(sym), np.int64)
            reps[odd] = size
            sym, unit = np.repeat(sym, reps), np.repeat(unit, reps)
            sym[np.repeat(odd, reps)] = self.bytes[np.frombuffer(raw, np.uint8)]
        return sym.astype(np.int32), np.r_[0, np.cumsum(np.bincount(unit, minlength=n))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end ids, and texts + 1 offsets."""
        out, offsets = self.units([units_of(t) for t in texts], 1, 1)
        out[offsets[:-1]], out[offsets[1:] - 1] = self.bos, self.eos
        return out, offsets

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.lib.decode(x) for x in ids]


def units_of(text: str) -> list[str]:
    """The units of a text, each without one leading space; the model puts one before the text."""
    if not text:
        return []
    text = text.replace(SPACE_MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [u[1:] for u in _UNIT.findall(" " + text)]


def load(path: str) -> PieceModel:
    """One model a worker process."""
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", values: bool = True) -> DataFrame:
    """One row a row of docs: key, n_tokens, ids_sha256, decoded_sha256 and, with values, ids and decoded.

    Ids include begin and end. A null text counts as empty: its ids are the two marks, its decoded text is empty.
    A null key passes through; rows that repeat give rows that repeat. Other columns of docs are not read, so their
    names can't clash. Very long texts are encoded whole, alone in their slice.
    """

    def work(part: TextSlice) -> list[pa.Array]:
        m = load(model)
        flat, at = m.encode(part.strings)
        wide, cuts = flat.astype("<u4").view(np.uint8), (at * 4).tolist()
        listed = [flat[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        decoded = m.decode(listed)
        out = [
            pa.array(np.diff(at)),
            pa.array([hashlib.sha256(wide[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string()),
            pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
        ]
        return out + ([pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat)), pa.array(decoded, pa.string())] if values else [])

    extra = ", ids array<int>, decoded string" if values else ""
    return per_text(docs, [key], text, "n_tokens long, ids_sha256 string, decoded_sha256 string" + extra, work)
