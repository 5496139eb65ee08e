"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

**Encoding.**  A text is fed in parts; whatever can no longer change is given out at once:

* special strings of the raw text, once a longer match is impossible;
* normalised text up to a character that nothing composes with;
* words that another character has closed;
* inside a word that is still open, tokens that end ``lookahead`` symbols or more before the
  last known symbol.

``lookahead`` follows from the merge list alone.  Let two texts agree before position q.
Merges run by rank, so what differs between the two moves left of q only when a rule (u, v)
joins across the leftmost difference, by the length of u, and each next rule has a higher
rank and a v that begins with the last u (u lies on its chain of left parts).  The longest
such chain, found in one pass over the list in rank order, is the lookahead: tokens that
end so far before q are the same in both texts, whatever follows.  This needs a list in
which each token has one rule and parts come before wholes; for others (``lookahead`` is
None) a word is kept until it ends, and the ids are right all the same.

A part costs its own length; what is kept is a part, a block of an open word and a bounded
memo of short words.  (A run of combining marks has no place where a normal form may be
cut, so it is kept whole, as is a special string.)

**Decoding** is a state machine too: ids in, text out as soon as bytes are whole
characters, bytes that are no UTF-8 as replacement characters.

Classes, lower case and normal forms of characters are those of the installed Unicode
tables; ids were seen to differ from the library's for characters that Unicode assigned
after version 15.1, and for 59 combining marks before another mark.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rounds import ROUNDS_LENGTH, PairTable, merge_rounds

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
PART = 1 << 16  # characters of a text that are fed at once
BLOCK = 4096  # symbols of an open word that are merged at once, beside the lookahead
SHORT = 48  # symbols of a word whose best pair is looked for in a list, not a heap
MEMO_WORDS, MEMO_LENGTH = 400_000, 64  # words a task remembers, and the longest of them

CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")  # fixed by the tokenizers
_CONTRACTED = "|".join(CONTRACTIONS)
#: The two ways of cutting words that the vocabulary files use, as in those files.
PLAIN_WORDS = _CONTRACTED + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACED_WORDS = _CONTRACTED + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GOES_ON = {kind: regex.compile(f"{chars}*") for kind, chars in {"letter": r"\p{L}", "number": r"\p{N}", "other": r"[^\s\p{L}\p{N}]", "space": r"\s"}.items()}
_BETWEEN = regex.compile(r"(?<=\S) (?=\S)")  # where SPACED_WORDS always begin a word
_LETTER, _NUMBER, _SPACE = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\s")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else one from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in set(shown))
    return [chr(c) for _, c in sorted([*((b, b) for b in shown), *((b, 256 + k) for k, b in enumerate(rest))])]


class _Memo(dict):
    """Ids of short words, each encoded once; emptied when it is full."""

    def __init__(self, table: "Bpe"):
        self.table, self.most = table, MEMO_WORDS

    def __missing__(self, word: str) -> list[int]:
        stream = WordStream(self.table)
        ids = [*stream.feed(word), *stream.close()]
        if len(word) <= MEMO_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


@dataclass
class Bpe:
    """A byte-level BPE vocabulary with all that encoding and decoding need."""

    ids: dict  # token -> id
    merges: list  # (left, right) by rank
    special: dict  # special string -> id
    suffix: str = ""  # ends the last symbol of a word
    plain: bool = False  # PLAIN_WORDS of normalised text, or SPACED_WORDS of the text itself
    joined_bytes: bool = True  # decoding gives the tokens' bytes, or the tokens with spaces between
    memo: dict | None = field(default=None, repr=False)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("ids", "merges", "special", "suffix", "plain", "joined_bytes")} | {"memo": None}

    @cached_property
    def rules(self) -> dict:
        """(left id, right id) -> (rank, id of both)."""
        return {(self.ids[a], self.ids[b]): (k, self.ids[a + b]) for k, (a, b) in enumerate(self.merges)}

    @cached_property
    def pairs(self) -> PairTable:
        rows = [(a << 32 | b, whole, rank) for (a, b), (rank, whole) in self.rules.items()]
        return PairTable(*np.array(rows, dtype=np.int64).reshape(-1, 3).T.copy())

    @cached_property
    def inner(self) -> list[int]:
        return [self.ids.get(s, -1) for s in byte_symbols()]

    @cached_property
    def last(self) -> list[int]:
        return [self.ids.get(s + self.suffix, -1) for s in byte_symbols()]

    @cached_property
    def size(self) -> dict:
        """Symbols of each token."""
        sizes = {i: 1 for i in {*self.inner, *self.last}}
        for a, b in self.merges:
            sizes[self.ids[a + b]] = sizes.get(self.ids[a], 1) + sizes.get(self.ids[b], 1)
        return sizes

    @cached_property
    def lookahead(self) -> int | None:
        return lookahead([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in self.merges], self.size)

    @cached_property
    def tokens(self) -> list[str]:
        names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        return [names.get(i, "") for i in range(max(names, default=-1) + 1)]

    @cached_property
    def shown(self) -> list[bytes]:
        """Bytes of each id; a token with a character that stands for no byte is its own text."""
        value = {s: b for b, s in enumerate(byte_symbols())}
        return [bytes(map(value.__getitem__, t)) if all(c in value for c in t) else t.encode() for t in self.tokens]

    @cached_property
    def decimals(self) -> list[str]:
        return [str(i) for i in range(len(self.tokens))]

    @cached_property
    def specials(self):
        """Finds special strings, the longest first, or None."""
        return regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @cached_property
    def words(self):
        return regex.compile(PLAIN_WORDS if self.plain else SPACED_WORDS)

    def known(self) -> "_Memo":
        if self.memo is None:
            self.memo = _Memo(self)
        return self.memo


def load(path: str = TOKENIZER, special: bool = True) -> Bpe:
    """Read a tokenizer file.  ``special``: special strings inside texts are special tokens
    (they are plain text otherwise).  Supported are byte-level BPE with one of the two ways of
    cutting words, without a normaliser or with NFC, white space as spaces and lower case."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, steps = data["model"], data["pre_tokenizer"]
    steps = steps.get("pretokenizers", [steps])
    normal = [n["type"] for n in (data["normalizer"] or {}).get("normalizers", [])]
    plain = len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["pattern"].get("Regex") == PLAIN_WORDS and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    spaced = len(steps) == 1 and steps[0].get("use_regex") and not steps[0]["add_prefix_space"]
    added = data.get("added_tokens") or []
    wanted = (
        model["type"] == "BPE"
        and steps[-1]["type"] == "ByteLevel"
        and ((plain and normal == ["NFC", "Replace", "Lowercase"]) or (spaced and not data["normalizer"]))
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        and (data["decoder"] is None or data["decoder"]["type"] == "ByteLevel")
    )
    if not wanted:
        raise ValueError("this kind of tokenizer is not supported")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    found = Bpe(model["vocab"], merges, {t["content"]: t["id"] for t in added}, model.get("end_of_word_suffix") or "", plain, data["decoder"] is not None)
    return found if special else Bpe(found.ids | found.special, merges, {}, found.suffix, plain, found.joined_bytes)


def lookahead(rules: list[tuple[int, int, int]], size: dict) -> int | None:
    """Symbols after a token's end that settle it, for rules (left, right, whole) by rank;
    None if a token has two rules or a rule comes before one that makes its part."""
    left, made_at = {}, {}
    for rank, (_, _, whole) in enumerate(rules):
        if whole in made_at:
            return None
        made_at[whole] = rank
    longest: dict[int, int] = {}  # of the chains that end with a rule of this left part
    most = 0
    for rank, (a, b, whole) in enumerate(rules):
        if max(made_at.get(a, -1), made_at.get(b, -1)) >= rank:
            return None
        before, part = 0, b
        while part is not None:
            before = max(before, longest.get(part, 0))
            part = left.get(part)
        longest[a] = max(longest.get(a, 0), before + size[a])
        most = max(most, longest[a])
        left[whole] = a
    return most


_NO_RULE = (1 << 62, -1)


def _merge_short(symbols: list[int], rules: dict) -> list[int]:
    get = rules.get
    found = [get(pair, _NO_RULE) for pair in zip(symbols, symbols[1:])]
    while found and (best := min(found)) is not _NO_RULE:
        k, whole = found.index(best), best[1]
        symbols[k] = whole
        del symbols[k + 1], found[k]
        if k:
            found[k - 1] = get((symbols[k - 1], whole), _NO_RULE)
        if k < len(found):
            found[k] = get((whole, symbols[k + 1]), _NO_RULE)
    return symbols


def merge(symbols: list[int], rules: dict) -> list[int]:
    """Neighbours are joined by rank, the leftmost first."""
    n = len(symbols)
    if n <= SHORT:
        return _merge_short(symbols, rules)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = rules.get
    heap = [(found[0], k, found[1], symbols[k], symbols[k + 1]) for k in range(n - 1) if (found := get((symbols[k], symbols[k + 1])))]
    heapq.heapify(heap)
    while heap:
        _, k, whole, a, b = heapq.heappop(heap)
        other = after[k]
        if symbols[k] != a or other >= n or symbols[other] != b:
            continue
        symbols[k], symbols[other] = whole, -1
        after[k] = z = after[other]
        if z < n:
            before[z] = k
            if found := get((whole, symbols[z])):
                heapq.heappush(heap, (found[0], k, found[1], whole, symbols[z]))
        if (p := before[k]) >= 0 and (found := get((symbols[p], whole))):
            heapq.heappush(heap, (found[0], p, found[1], symbols[p], whole))
    return [s for s in symbols if s >= 0]


class WordStream:
    """One word, fed in parts: ids as soon as no later character can change them."""

    def __init__(self, table: Bpe):
        self.table, self.held = table, b""

    def feed(self, part: str) -> list[int]:
        self.held += part.encode("utf-8", "replace")
        reach, out = self.table.lookahead, []
        while reach is not None and len(self.held) > reach + BLOCK:
            # the last byte may be the word's last symbol, so it is not known yet
            known = min(len(self.held) - 1, 2 * (reach + BLOCK))
            ids, at = merge([self.table.inner[b] for b in self.held[:known]], self.table.rules), 0
            for i in ids:
                if at + self.table.size[i] > known - reach:
                    break
                at += self.table.size[i]
                out.append(i)
            self.held = self.held[at:]
            if not at:
                break
        return out

    def close(self) -> list[int]:
        held, self.held = self.held, b""
        symbols = [self.table.inner[b] for b in held]
        if held:
            symbols[-1] = self.table.last[held[-1]]
        return merge(symbols, self.table.rules)


def encode_many(words: list[str], table: Bpe) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of ids of each), what ``WordStream`` gives: words of at most
    ``ROUNDS_LENGTH`` bytes are merged together."""
    coded = [w.encode("utf-8", "replace") for w in words]
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    short = np.flatnonzero((sizes > 0) & (sizes <= ROUNDS_LENGTH))
    data = np.frombuffer(b"".join([coded[k] for k in short] if len(short) < len(coded) else coded), dtype=np.uint8)
    symbol, last = np.array(table.inner)[data], np.cumsum(sizes[short]) - 1
    symbol[last] = np.array(table.last)[data[last]]
    word, ids = merge_rounds(symbol, np.repeat(short, sizes[short]), table.pairs)
    parts = [(word[ids >= 0], ids[ids >= 0])]
    for k in np.flatnonzero(sizes > ROUNDS_LENGTH).tolist():
        stream = WordStream(table)
        found = [*stream.feed(words[k]), *stream.close()]
        parts.append((np.full(len(found), k), np.array(found, dtype=np.int64)))
    word, ids = (np.concatenate(x) for x in zip(*parts))
    if len(parts) > 1:
        order = np.argsort(word, kind="stable")
        word, ids = word[order], ids[order]
    return ids.astype(np.int32), np.bincount(word, minlength=len(words))


def word_lists(text: str, table: Bpe):
    """Lists of the words of a text, part by part, for a table without special strings and
    normal form: a text may be cut before a single space between other characters."""
    at = 0
    while at < len(text):
        found = _BETWEEN.search(text, at + PART)
        stop = found.start() if found else len(text)
        yield table.words.findall(text[at:stop])
        at = stop


def _composes(char: str) -> bool:
    """Whether a character may join those before it in the normal form."""
    return unicodedata.category(char)[0] == "M" or "ᄀ" <= char <= "ᇿ"


def _normal(text: str, table: Bpe) -> str:
    if not table.plain or not text:
        return text
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character by itself, also at the end of a word
    return text.lower()


class Encoder:
    """One text, fed in parts: ``feed`` and ``close`` give the ids that are settled."""

    def __init__(self, table: Bpe):
        self.table, self.raw = table, ""
        self.tail = ""  # normalised characters whose word is open to more than one reading
        self.open: tuple[str, WordStream] | None = None
        self.longest = max(map(len, table.special), default=1)

    def feed(self, part: str) -> list[int]:
        self.raw += part
        return self._take(self._safe()) if len(self.raw) >= PART else []

    def close(self) -> list[int]:
        return self._take(len(self.raw), True)

    def _safe(self) -> int:
        """A place near the end where the text may be cut."""
        raw, stop = self.raw, len(self.raw) - self.longest
        place = max(raw.rfind(" ", 1, stop), raw.rfind("\n", 1, stop), 0)
        if not place:
            place = stop
            while place > 0 and _composes(raw[place]):
                place -= 1
        if self.table.specials is not None:
            for found in self.table.specials.finditer(raw):
                if found.start() < place < found.end():
                    return found.end()
        return max(place, 0)

    def _take(self, stop: int, last: bool = False) -> list[int]:
        text, self.raw = self.raw[:stop], self.raw[stop:]
        out, at = [], 0
        if self.table.specials is not None:
            for found in self.table.specials.finditer(text):
                out += self._words(text[at : found.start()], True)
                out.append(self.table.special[found.group()])
                at = found.end()
        return out + self._words(text[at:], last)

    def _words(self, text: str, ends: bool) -> list[int]:
        """Ids of the words of a segment's next part; ``ends``: it is the last one."""
        text, self.tail = self.tail + _normal(text, self.table), ""
        out: list[int] = []
        at = 0
        if self.open is not None:
            kind, stream = self.open
            at = _GOES_ON[kind].match(text).end()
            if kind == "space" and at < len(text):  # the last white space may belong to the next word
                at = max(at - 1, 0)
            if kind == "space" and at == len(text) and not ends:
                at -= at > 0
            out += stream.feed(text[:at])
            if at == len(text) and not ends:
                return out
            if kind == "space" and not ends and not text[at:].strip():
                self.tail = text[at:]
                return out
            out += stream.close()
            self.open = None
        words = self.table.words.findall(text, at)
        if not ends and words and text.endswith(words[-1]):
            self._hold(words)
        known = self.table.known()
        out.extend(chain.from_iterable(map(known.__getitem__, words)))
        return out

    def _hold(self, words: list[str]) -> None:
        """Take the open last word out of ``words``."""
        word = words.pop()
        if word in CONTRACTIONS:
            words.append(word)
        elif word == "'" or (words and words[-1] == "'" and word in ("r", "v", "l")):
            self.tail = (words.pop() if word != "'" else "") + word
        elif _SPACE.match(word[-1]):
            if word == " " or len(word) == 1:
                self.tail = word
            else:
                self._begin("space", word[:-1])
                self.tail = word[-1]
        elif _LETTER.match(word[-1]):
            self._begin("letter", word)
        elif not _NUMBER.match(word[-1]):
            self._begin("other", word)
        elif self.table.plain:  # digits stand alone
            words.append(word)
        else:
            self._begin("number", word)

    def _begin(self, kind: str, word: str) -> None:
        stream = WordStream(self.table)
        stream.held = word.encode("utf-8", "replace")
        self.open = kind, stream


def encoded_parts(text: str | None, table: Bpe):
    """Lists of ids of a text, part by part."""
    encoder, text = Encoder(table), text or ""
    for k in range(0, len(text), PART):
        yield encoder.feed(text[k : k + PART])
    yield encoder.close()


class Decoder:
    """Ids in parts to text: ``feed`` gives the characters that are whole, ``close`` the
    rest.  Ids outside the vocabulary give nothing."""

    def __init__(self, table: Bpe):
        self.table, self.begun = table, False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        n = len(self.table.tokens)
        if ids and not (min(ids) >= 0 and max(ids) < n):
            ids = [i for i in ids if 0 <= i < n]
        if self.table.joined_bytes:
            return self.machine.decode(b"".join(map(self.table.shown.__getitem__, ids)))
        if not ids:
            return ""
        text = " ".join(map(self.table.tokens.__getitem__, ids))
        text, self.begun = (" " + text if self.begun else text), True
        return text

    def close(self) -> str:
        return self.machine.decode(b"", True)


_KINDS = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def encode(docs: DataFrame, table: Bpe, text_col: str = "text", carry: list[str] | None = None, outputs=("ids",)) -> DataFrame:
    """``carry`` (default: doc_id) and ``outputs``: ids, n_tokens, ids_sha256 (of the decimal
    ids with spaces between), decoded, decoded_sha256 (of what the ids decode to).  Digests
    are taken part by part, so nothing grows with a text but the columns asked for.

    Null and empty texts have no tokens; repeated rows are rows of their own.  No shuffle."""
    carried = list(carry or ["doc_id"])
    schema = T.StructType([*docs.select(*carried).schema.fields, *[T.StructField(o, _KINDS[o]) for o in outputs]])
    shared = docs.sparkSession.sparkContext.broadcast(table)  # its size is the vocabulary's

    def row(text: str | None, bpe: Bpe) -> tuple:
        back, ids_sha, text_sha, n = Decoder(bpe), hashlib.sha256(), hashlib.sha256(), 0
        kept: dict = {"ids": [], "decoded": []}
        decode, numbers = any(o.startswith("decoded") for o in outputs), "ids_sha256" in outputs
        for ids in encoded_parts(text, bpe):
            if numbers and ids:
                ids_sha.update(((" " if n else "") + " ".join(map(bpe.decimals.__getitem__, ids))).encode())
            n += len(ids)
            if decode:
                text = back.feed(ids)
                text_sha.update(text.encode())
                if "decoded" in outputs:
                    kept["decoded"].append(text)
            if "ids" in outputs:
                kept["ids"] += ids
        rest = back.close()
        text_sha.update(rest.encode())
        found = {"ids": kept["ids"], "n_tokens": n, "ids_sha256": ids_sha.hexdigest(), "decoded": "".join([*kept["decoded"], rest]), "decoded_sha256": text_sha.hexdigest()}
        return tuple(found[o] for o in outputs)

    def run(batches):
        bpe = shared.value
        for batch in batches:
            rows = [row(t.as_py(), bpe) for t in batch.column(batch.num_columns - 1)]
            columns = [pa.array([r[k] for r in rows], _arrow(o)) for k, o in enumerate(outputs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*carried, *outputs])

    return docs.select(*carried, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def _arrow(output: str) -> pa.DataType:
    return {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}.get(output, pa.string())


def decode(encoded: DataFrame, table: Bpe, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give null."""
    names = [c for c in encoded.columns if c != into]
    schema = T.StructType([*encoded.select(*names).schema.fields, T.StructField(into, T.StringType())])
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def text(ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        back, out = Decoder(shared.value), []
        for k in range(0, len(ids), PART):
            out.append(back.feed([i for i in ids[k : k + PART] if i is not None]))
        return "".join([*out, back.close()])

    def run(batches):
        for batch in batches:
            column = pa.array([text(ids.as_py()) for ids in batch.column(batch.schema.get_field_index(ids_col))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*names, into])

    return encoded.select(*names).mapInArrow(run, schema)


def op11_bpe_transducer(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text of ``documents``.
    Null and empty texts have no tokens and the digests of nothing; equal rows stay apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, load(tokenizer), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
