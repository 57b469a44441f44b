"""Secret scan: three fixed patterns, and random strings exposed by their token efficiency."""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame

from .common import map_batches
from .tokens import vocabulary

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
# lengths of hexadecimal digests that identify public content: md5, sha-1, sha-224, sha-256, sha-384, sha-512
DIGESTS = (32, 40, 56, 64, 96, 128)

_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NAME = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[-_/](?:[A-Za-z]+|[0-9]+))+")
_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    """The tiktoken vocabulary of a rank file, loaded once per Python worker."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def known_form(run: str) -> bool:
    """A digest of public length, a UUID, or an identifier of plain words and numbers joined by - _ or /."""
    return bool(_HEXADECIMAL.fullmatch(run) and len(run) in DIGESTS or _UUID.fullmatch(run) or _NAME.fullmatch(run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, by start and then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, int]], encoding, most: float, one_case: float) -> list[tuple[int, int, int]]:
    """Runs with letters that cost a token per `most` characters or fewer (per `one_case`, if all letters but the first are
    of one case and no digit stands among them), outside base spans and known forms."""
    out = []
    for m in _RUN.finditer(text):
        run = m[0]
        if not any(c.isalpha() for c in run) or known_form(run):
            continue
        if any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        rest = run[1:]
        varied = any(c.isdigit() for c in run) or (rest != rest.lower() and rest != rest.upper())
        if len(run) <= (most if varied else one_case) * len(encoding.encode_ordinary(run)):
            out.append((m.start(), 3, m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, path: str | None = None, most: float = 2.0, one_case: float = 1.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: (id, n_assign, n_access, n_hex, base_sha256, spans, n_random), one row per input row.

    Base matches are always reported; a run of 20 or more of `A-Za-z0-9+/_=-` with a letter is added as `random` if a token of
    the vocabulary covers `most` characters or fewer on average, unless it is a digest, a UUID or an identifier, or overlaps a base
    match. Runs without digits whose letters after the first are all of one case, as in long words, need `one_case`. Spans are code points, end exclusive. A null or empty text has
    no spans (empty string; the digest is that of the empty string); null ids stay null, repeated rows are scanned
    each, other columns are left aside, an empty table gives an empty result. One narrow pass, no shuffle.
    """
    path = path or vocabulary("byte_bpe_50k.tiktoken")

    def run(columns):
        ids, texts = columns
        out = [ids, [], [], [], [], [], []]
        encoding = _encoding(path)
        for text in texts:
            text = text or ""
            base = base_spans(text)
            added = random_spans(text, base, encoding, most, one_case)
            kinds = [k for _, k, _ in base]
            for column, value in zip(out[1:], (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(),
                                               joined(sorted(base + added)), len(added))):
                column.append(value)
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, run, [id_col, text_col], f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint")
