"""Secret scans by dictionary-primed zstandard novelty.

Method: a candidate is a string that a sensitive name is given (``password=``,
``token: "..."``, an authorisation header), that stands under a PEM private key's heading, or that
begins as an issuer's keys do (``AKIA``, ``ghp_``), whole, however long it or its name is.  A compressor primed with a dictionary
of code and identifiers compresses the text around the candidate (``around`` characters either side: what is near is what it could repeat) once without and
once with it; the difference is what the candidate adds (its own copies nearby are left
out of the surroundings).  Words, placeholders and
identifiers, which the dictionary or the surroundings have, add little; a random
key adds close to its entropy.  Candidates that add enough bytes, and enough for
each character, are reported.

Plan: one pass without a shuffle; texts without a sensitive name or prefix are passed over by one
linear-time regular expression over the Arrow batch, before they become Python strings.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from .common import batch, id_text
from .textkernel import strings

AROUND = 400
MIN_BYTES = 8
MIN_RATIO = 0.38
NAMES = "api[ _-]?key|access[ _-]?key|secret|passwd|password|passphrase|pwd|token|credential|auth|bearer|private[ _-]?key|client[ _-]?secret|conn(?:ection)?[ _-]?str(?:ing)?"
SENSITIVE = re.compile(rf"(?i)(?:{NAMES})")
#: The longest part of a name before a blank, where another name may begin at the end of a run of name characters.
BEFORE_BLANK = len("connection")
REST_OF_NAME = re.compile(r"[\w.-]*+")
VALUE = re.compile(r"""(?i)["']?(?:\s*+(?:[:=]{1,2}>?|\bis\b)\s*+|\s++)(?:(?P<q>["'`])(?P<quoted>[^"'`\s]{8,}+)(?P=q)|(?P<bare>[A-Za-z0-9+/_.~$!@#%^&*-]{8,}+={0,2}))""")
_BREAK = r"(?:\s|\\[nr])"  # written out in strings of code
#: What follows "PRIVATE KEY": headers, long lines, and shorter ones before the end mark.
PEM = re.compile(rf"(?: BLOCK)?-----{_BREAK}*+(?:[A-Za-z][\w-]*+: [^\n\\]*+{_BREAK}++)*+(?P<pem>[A-Za-z0-9+/]{{32,}}+={{0,2}}(?:{_BREAK}++[A-Za-z0-9+/]{{32,}}+={{0,2}})*+(?:(?:{_BREAK}++=?[A-Za-z0-9+/]++={{0,2}}){{1,2}}(?={_BREAK}*+-----))?)")
#: Keys that are known by how they begin, wherever they stand.
ISSUED = re.compile(r"(?<![A-Za-z0-9_-])(?P<prefix>AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|sk-|sk_live_|eyJ)(?P<rest>[A-Za-z0-9_-]{16,}+(?:\.[A-Za-z0-9_-]++)*+)")
PREFILTER = f"(?i:{NAMES})|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|sk-|sk_live_|eyJ"
#: What a key would be new against: words of code, placeholders and names.
DICTIONARY = (
    "function return import from class public private static void string int boolean null true false none self this value default config settings options "
    "example changeme change_me your_password your-api-key your_token_here placeholder xxxxxxxx ******** secret_key access_key api_key client_secret client_id "
    "password passwd username user admin root token bearer authorization credentials getenv environ process.env os.environ request.headers get_secret vault "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 12345678 qwertyuiop password123 letmein test testing localhost http https www .com "
    "required invalid expired missing authentication authenticate validation generate_token refresh_token access_token session cookie header response connection database "
    "the that with for and this was are from have not but which their been were would there could about between through during without against "
    "der die und das nicht eine von les des est que pour dans une avec los las para como más pero "
).encode() * 2


class Novelty:
    """Compressed bytes that a string adds to its surroundings, given the dictionary."""

    def __init__(self, dictionary: bytes = DICTIONARY, level: int = 3):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.press = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False)
        self.known = dictionary.lower()
        self.empty = len(self.press.compress(b""))

    def added(self, before: str, candidate: str, after: str) -> int:
        around, new = (before + after).replace(candidate, "").encode("utf-8", "replace"), candidate.encode("utf-8", "replace")  # a key that is repeated is no less a key
        size = lambda x: len(self.press.compress(x))
        if new.lower() in self.known:  # of a few bytes, a reference costs as many as they have
            return 0
        # a few bytes more can make the coding of the surroundings another one: what the dictionary alone has is not new either
        return min(size(around + new) - size(around), size(new) - self.empty)


def found(text: str, novelty: Novelty, around: int = AROUND, min_bytes: int = MIN_BYTES, min_ratio: float = MIN_RATIO) -> list[tuple[int, int, str, int, float]]:
    """(start, end, name, added bytes, added bytes a character) of each secret, in text order."""
    out, at, floor = [], 0, 0
    while m := SENSITIVE.search(text, at):
        which, until = "pem", m.end()
        v = PEM.match(text, until)
        if not v:
            until = REST_OF_NAME.match(text, until).end()
            v = VALUE.match(text, until)
            if not v:  # nor has another name in this run of characters a value
                at = max(m.end(), until - BEFORE_BLANK)
                continue
            which = "quoted" if v["quoted"] else "bare"
        a, b = v.span(which)
        value, start = v[which], m.start()
        added = novelty.added(text[max(0, a - around) : a], value, text[b : b + around])
        ratio = added / len(value)
        if added >= min_bytes and ratio >= min_ratio and (which != "bare" or re.search(r"\d", value)):
            while start > floor and (text[start - 1].isalnum() or text[start - 1] in "_.-"):
                start -= 1
            out.append((a, b, text[start:until], added, round(ratio, 6)))
            at = floor = b
        else:
            at = floor = until  # the value may itself be a name
    for m in ISSUED.finditer(text):
        a, b = m.span()
        if any(a < z and b > s for s, z, *_ in out) or not re.search(r"\d", m[0]):
            continue
        added = novelty.added(text[max(0, a - around) : a], m[0], text[b : b + around])
        if added >= min_bytes and added / len(m[0]) >= min_ratio:
            out.append((a, b, m["prefix"], added, round(added / len(m[0]), 6)))
    return sorted(out)


def secrets(docs: DataFrame, around: int = AROUND, min_bytes: int = MIN_BYTES, min_ratio: float = MIN_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, name, added_bytes, ratio): incompressible strings that a sensitive name is given, in characters of the text.

    Null and empty texts have none; a null id is left out; repeated rows are
    reported each; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("added_bytes", pa.int32()), ("ratio", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in batches:
            some = pc.match_substring_regex(strings(b.column(1)), PREFILTER)
            b = b.filter(some)
            out = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in found(t, novelty, around, min_bytes, min_ratio)]
            if out:
                yield batch(schema, list(zip(*out)))

    has = id_text(docs, id_col, text_col).where("doc_id is not null")
    return has.mapInArrow(run, "doc_id long, start int, end int, name string, added_bytes int, ratio double")
