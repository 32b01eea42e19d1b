"""Fill-in-middle samples of whole texts, cut on bytes with a sparse index of the characters longer than one byte."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.text import SLICE_BYTES, checked_columns, row_edges, slices, text_or_empty, texts

#: Prefix, suffix and middle mark.
MARKS = ("<P>", "<S>", "<M>")

LETTER = np.array([chr(b).isalpha() if b < 0x80 else False for b in range(256)])
#: Bytes behind the first one of a character, by its first byte.
BEHIND = np.array([0] * 0xC0 + [1] * 0x20 + [2] * 0x10 + [3] * 0x10, np.int64)


class Exceptions(NamedTuple):
    """Where the characters of several bytes begin in a text, and the bytes that they and those before exceed one by."""

    at: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Exceptions:
        at = np.flatnonzero(data >= 0xC0)
        return cls(at, np.concatenate([np.zeros(1, np.int64), np.cumsum(BEHIND[data[at]])]))

    def chars(self, cut: np.ndarray) -> np.ndarray:
        """Characters before each byte cut; a cut lies between characters."""
        return cut - self.excess[np.searchsorted(self.at, cut)]

    def bytes(self, cut: np.ndarray) -> np.ndarray:
        """The byte at which the character of each number begins; one past the last gives the end."""
        first = self.at - self.excess[:-1]
        return cut + self.excess[np.searchsorted(first, cut)]


class Cuts(NamedTuple):
    """Of each text: units, the two cuts in bytes and in characters."""

    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    low_chars: np.ndarray
    high_chars: np.ndarray


def unit_starts(data: np.ndarray, first: np.ndarray, after_letter: bool = False) -> np.ndarray:
    """Bytes at which a run of ASCII letters or another character begins; `first` are the first bytes of texts."""
    if not len(data):
        return np.zeros(0, np.int64)
    letter = LETTER[data]
    behind = np.empty_like(letter)
    behind[0] = after_letter
    behind[1:] = letter[:-1]
    behind[first[first < len(data)]] = False
    return np.flatnonzero(~(letter & behind) & ((data & 0xC0) != 0x80))


def cuts_of_many(data: np.ndarray, starts: np.ndarray, draws: np.ndarray) -> Cuts:
    """Cuts of short texts, all at once."""
    units = unit_starts(data, starts[:-1])
    edge = np.searchsorted(units, starts)
    n = np.diff(edge)
    picked = np.sort(draws % (n + 1), axis=0)
    at = np.append(units, len(data))
    exceptions = Exceptions.of(data)
    ends = [np.where(k < n, at[np.minimum(edge[:-1] + k, len(units))], starts[1:]) for k in picked]
    before = exceptions.chars(starts[:-1])
    return Cuts(n, *(e - starts[:-1] for e in ends), *(exceptions.chars(e) - before for e in ends))


def cuts_of_long(data: np.ndarray, draws: np.ndarray, stretch: int = SLICE_BYTES) -> Cuts:
    """Cuts of one long text in stretches, so that no index of the whole text stands in memory."""
    none = np.zeros(0, np.int64)

    def begun(a: int) -> np.ndarray:
        return a + unit_starts(data[a : a + stretch], none, bool(a and LETTER[data[a - 1]]))

    steps = list(range(0, len(data), stretch))
    total = np.cumsum([0, *(len(begun(a)) for a in steps)])
    over = np.cumsum([0, *(int(Exceptions.of(data[a : a + stretch]).excess[-1]) for a in steps)])
    n, found = int(total[-1]), []
    for k in sorted(int(d) % (n + 1) for d in draws):
        s = int(np.searchsorted(total, k, "right")) - 1
        at = len(data) if k == n else int(begun(steps[s])[k - total[s]])
        s = min(at // stretch, len(steps) - 1)
        local = at - steps[s]
        found.append((at, steps[s] - int(over[s]) + int(Exceptions.of(data[steps[s] : steps[s] + stretch]).chars(np.array([local]))[0])))
    column = lambda i, j: np.array([found[i][j]])
    return Cuts(np.array([n]), column(0, 0), column(1, 0), column(0, 1), column(1, 1))


def fill_in_middle(
    docs: DataFrame, *, seed: str = "1", percent: int = 90, suffix_first: int = 20, marks: tuple[str, str, str] = MARKS, stretch: int = SLICE_BYTES
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row.

    A text is cut into n units, runs of ASCII letters or single other characters. Two cuts are drawn from the
    SHA-256 of `seed`:doc_id; what stands between them is the middle. Form psm is prefix mark, prefix, suffix
    mark, suffix, middle mark, middle; spm (`suffix_first` percent of these) begins with suffix mark and suffix.
    A text that is empty, holds a mark, or is not drawn (`percent` are) stays plain, with null lengths.
    Null text is empty. A null id counts as an empty one. Equal rows stay separate rows and are cut alike. A text
    of more than `stretch` bytes is searched in stretches. An empty table gives an empty result; columns other
    than doc_id and text are not read.
    """
    c, body = F.col, text_or_empty()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for mark in marks:
        marked = marked | body.contains(mark)
    form = F.when((body == "") | marked | (draw[2] % 100 >= percent), "plain").when(draw[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = checked_columns(docs, "doc_id", "text").select(
        "doc_id", body.alias("text"), form.alias("form"), draw[0].alias("h1"), draw[1].alias("h2")
    )
    first, second, third = (m.encode() for m in marks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=stretch):
            data, starts = texts(part.column("text"))
            draws = np.stack([part.column(h).to_numpy(zero_copy_only=False) for h in ("h1", "h2")])
            long = part.num_rows == 1 and len(data) > stretch
            found = cuts_of_long(data, draws[:, 0], stretch) if long else cuts_of_many(data, starts, draws)
            forms, raw = part.column("form").to_pylist(), data.tobytes()
            out = []
            for i, kind in enumerate(forms):
                a, b = int(starts[i]), int(starts[i + 1])
                p, m = a + int(found.low[i]), a + int(found.high[i])
                if kind == "plain":
                    out.append(raw[a:b])
                elif kind == "psm":
                    out.append(b"".join([first, raw[a:p], second, raw[m:b], third, raw[p:m]]))
                else:
                    out.append(b"".join([second, raw[m:b], first, raw[a:p], third, raw[p:m]]))
            plain = np.array([k == "plain" for k in forms])
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    pa.array(found.n, pa.int64()),
                    part.column("form"),
                    pa.array(found.low_chars, pa.int64(), mask=plain),
                    pa.array(found.high_chars - found.low_chars, pa.int64(), mask=plain),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which an output was made. Its parts hold no mark, so the marks are found without their places."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks))
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
