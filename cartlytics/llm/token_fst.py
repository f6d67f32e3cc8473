"""Token counts by a compiled finite-state tokenizer.

The vocabulary file of a word-end BPE is compiled to two deterministic machines:

* The pre-tokenizer: a regular expression over letters, numbers and other characters that splits a
  lower-cased text into pre-tokens.
* The transducer of a pre-token: reading its symbols left to right, the state is the list of last
  tokens of the prefixes read so far, and a transition annotates the new prefix with the number
  of tokens emitted up to it.  The last token of a prefix is the one suffix of it in the
  vocabulary whose boundary to the last token before it no merge crosses; these boundary
  tests (pairs of tokens) are the machine's table.  Counts of whole pre-tokens are kept as
  transitions of their own.

A text is cut into chunks, wherever the cut falls.  A chunk's state map is what it does to any state it
may be entered in: the part before its first white space (read in the state left open by the chunk before
it), the tokens emitted from there to its last white space, and the part after it, which is the state
it leaves open.  Maps compose associatively, so chunks are counted in any order and place, and a
document's maps are composed as a prefix scan over neighbours, halving their number each time.

Counts equal those of the library: special strings count as one token wherever they stand, text is
normalised to NFC and lower-cased character by character, and nothing is added at the ends.

Cases: null and empty texts have 0 tokens and 0 bytes; repeated rows each give a row, rows that share a
doc_id too; texts without white space are one open state until the end; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlytics.llm.common import per_process, ship, small_batches, text_or_empty

ship(__name__)

LIMIT = 2048
CHUNK = 1 << 16
# White space as the vocabulary's normaliser has it (fixed values: the Unicode property White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def letters_and_numbers() -> tuple[str, str, str]:
    """Character classes, as ranges: the Unicode categories L* and N*, and, of the first plane, the
    numbers that are not decimal digits."""
    import unicodedata

    ranges: dict[str, list[list[int]]] = {"L": [], "N": [], "odd": []}
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        for kind in (category[0], "odd" if category in ("Nl", "No") and c < 0x10000 else ""):
            own = ranges.get(kind)
            if own and own[-1][1] == c - 1:
                own[-1][1] = c
            elif own is not None:
                own.append([c, c])
    return tuple("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in own) for own in ranges.values())


class WordEndBpe:
    """The compiled machines of a word-end, byte-level BPE vocabulary file (tokenizers' JSON)."""

    def __init__(self, source: str, remember: int = 600_000):
        import re

        spec = json.loads(source)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.known = model["vocab"]
        self.made = {}  # how a token is made
        for pair in self.rank:
            self.made.setdefault("".join(pair), pair)
        # the longest token that ends in some (up to 3) symbols: inside a pre-token, and at its end
        self.reach, self.reach_end = {}, {}
        for token in self.known:
            table, body = (self.reach_end, token[:-len(self.end)]) if token.endswith(self.end) else (self.reach, token)
            for k in (2, 3):
                table[body[-k:]] = max(table.get(body[-k:], 0), len(body))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letters, numbers, odd = letters_and_numbers()
        short = "'s|'t|'re|'ve|'m|'ll|'d|"
        self.any_tokens = re.compile(f"{short}[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+").findall
        # the same for texts without numbers that are not decimal digits, in built-in classes, which are faster
        self.plain_tokens = re.compile(f"{short}[^\\W\\d_]+|\\d|(?:[^\\w{SPACE}]|_)+").findall
        self.odd = re.compile(f"[{odd}]").search
        self.space = re.compile(f"[{SPACE}]")
        # byte-level alphabet: printable bytes stand for themselves, the others for code points from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.symbol = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.counts: dict[str, int] = {}
        self.states: dict[str, tuple] = {}
        self.boundaries: dict[tuple, bool] = {}
        self.wholes: dict[str, bool] = {}
        self.remember = remember

    def merged(self, symbols: list[str]) -> list[str]:
        """The tokens of a short symbol sequence, merge by merge."""
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(symbols, symbols[1:])]
            least = min(ranks)
            if least == 1 << 30:
                break
            i = ranks.index(least)  # the leftmost of the first merge
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def symbols_of(self, token: str) -> list[str]:
        if token.endswith(self.end):
            body = token[:-len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def whole(self, token: str) -> bool:
        """Whether the symbols of a vocabulary entry merge into that entry."""
        got = self.wholes.get(token)
        if got is None:
            got = self.wholes[token] = self.merged(self.symbols_of(token)) == [token]
        return got

    def stands(self, left: str, right: str) -> bool:
        """Whether no merge crosses the boundary of these neighbouring tokens.

        Goes back in time from the finished tokens, undoing the later of the merges beside the
        boundary each time.  The pieces that face each other merge if their rank is under that of the
        merges that take either away; of equal ranks, the left one comes first."""
        got = self.boundaries.get((left, right))
        if got is None:
            if len(self.boundaries) >= self.remember:
                self.boundaries.clear()
            rank, made = self.rank, self.made
            a, b, a_goes, b_goes = left, right, 1 << 30, 1 << 30
            while True:
                crossing = rank.get((a, b), 1 << 30)
                if crossing < a_goes and crossing <= b_goes and crossing != 1 << 30:
                    got = False
                    break
                at, bt = rank.get(made.get(a), -1), rank.get(made.get(b), -1)
                if at < 0 and bt < 0:
                    got = True
                    break
                if at > bt:
                    a, a_goes = made[a][1], at
                else:
                    b, b_goes = made[b][0], bt
            self.boundaries[left, right] = got
        return got

    def count(self, pre_token: str) -> int:
        """Tokens of one pre-token: one run of the transducer."""
        text = "".join(map(self.symbol.__getitem__, pre_token.encode("utf-8", "surrogatepass")))
        n, known, end, boundaries = len(text), self.known, self.end, self.boundaries
        begun = self.states.get(text[:8]) if n > 8 else None
        if begun is None:
            last, emitted, start = [""], [0], 1
        else:
            last, emitted, start = [*begun[0]], [*begun[1]], 9
        last += [""] * (n + 1 - start)
        emitted += [0] * (n + 1 - start)
        for at in range(start, n + 1):
            if at < n:
                tail, reach = "", self.reach
            else:
                tail, reach = end, self.reach_end
            most = reach.get(text[max(0, at - 3):at]) or reach.get(text[max(0, at - 2):at]) or 1
            for size in range(min(at, most), 0, -1):
                token = text[at - size:at] + tail
                if token in known:
                    left = last[at - size]
                    if left:
                        fits = boundaries.get((left, token))
                        if fits is None:
                            fits = self.stands(left, token)
                    else:
                        fits = self.whole(token)
                    if fits:
                        last[at], emitted[at] = token, emitted[at - size] + 1
                        break
        if begun is None and n > 8:  # the state that all pre-tokens with these first 8 symbols share
            if len(self.states) >= self.remember // 4:
                self.states.clear()
            self.states[text[:8]] = (tuple(last[:9]), tuple(emitted[:9]))
        if len(self.counts) >= self.remember:
            self.counts.clear()
        self.counts[pre_token] = emitted[n]
        return emitted[n]

    def run(self, text: str) -> int:
        """Tokens of a stretch of text that is entered and left at white space or an end."""
        from unicodedata import is_normalized, normalize

        total = 0
        if self.special_pattern is not None and "<|" in text:
            parts = self.special_pattern.split(text)
            total = len(parts) - 1
        else:
            parts = [text]
        counts, count = self.counts, self.count
        for part in parts:
            if not is_normalized("NFC", part):
                part = normalize("NFC", part)
            part = part.replace("Σ", "σ").lower()  # lower-casing knows no word ends here
            plain = part.isascii() or not self.odd(part) and len(part.encode("utf-16-le", "surrogatepass")) == 2 * len(part)
            for word in self.plain_tokens(part) if plain else self.any_tokens(part):
                got = counts.get(word)
                total += count(word) if got is None else got
        return total

    def state_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(before, emitted, after): see the module's docstring; emitted is None without white space."""
        first = self.space.search(chunk)
        if first is None:
            return chunk, None, ""
        last = max(i for i in (chunk.rfind(s, first.start()) for s in (" ", "\n", first.group())) if i >= 0)
        return chunk[:first.start()], self.run(chunk[first.start():last]), chunk[last:]

    def compose(self, f: tuple, g: tuple) -> tuple:
        if f[1] is None:
            return (f[0] + g[0], g[1], g[2])
        if g[1] is None:
            return (f[0], f[1], f[2] + g[0])
        return (f[0], f[1] + self.run(f[2] + g[0]) + g[1], g[2])

    def finish(self, f: tuple) -> int:
        return self.run(f[0]) if f[1] is None else self.run(f[0]) + f[1] + self.run(f[2])


def count_batches(source, name: str):
    """mapInArrow: doc_id, text -> doc_id, n_bytes, n_tokens; ``source``: broadcast vocabulary file,
    ``name``: its digest."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        machine = per_process("word_end_bpe_" + name, lambda: WordEndBpe(source.value))
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1).to_pylist():
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                maps = [machine.state_map(text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)]
                while len(maps) > 1:  # neighbours compose, level by level
                    maps = [machine.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
                tokens.append(machine.finish(maps[0]) if maps else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


COUNTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.  ``vocabulary``: path of the file on
    the driver; its text (1.7 MB for 49k entries) is broadcast and compiled once a worker process."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as file:
        content = file.read()
    source, name = spark.sparkContext.broadcast(content), hashlib.sha256(content.encode()).hexdigest()
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(count_batches(source, name), COUNTS)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
