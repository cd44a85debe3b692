"""Character encodings of binary documents. Detection is JVM-side; decoding goes through Arrow, as only
Python's codecs follow web labels and tell of replaced bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Web labels whose meaning differs from Python's codec of that name.
LABELS = {"iso-8859-1": "windows-1252", "latin1": "windows-1252", "latin-1": "windows-1252", "us-ascii": "windows-1252", "ascii": "windows-1252", "iso-8859-9": "windows-1254", "gb2312": "gbk", "shift_jis": "shift_jis", "utf8": "utf-8", "utf-16": "utf-16le", "unicode": "utf-16le"}
KNOWN = ["utf-8", "utf-16le", "utf-16be", "windows-1252", "windows-1251", "windows-1250", "windows-1254", "iso-8859-2", "iso-8859-5", "iso-8859-7", "iso-8859-15", "koi8-r", "gbk", "gb18030", "big5", "euc-jp", "shift_jis", "euc-kr"]

_DECLARED = r"""\A\s*<\?xml\s+version\s*=\s*["']([^"']*)["'](?:\s+encoding\s*=\s*["']([^"']*)["'])?"""


def guess(data: Column) -> Column:
    """struct<encoding, error>: by byte order mark, else by the XML declaration, else UTF-8."""
    head = F.hex(F.substring(data, 1, 3))
    start = F.decode(F.substring(data, 1, 256), "iso-8859-1")
    version, label = F.regexp_extract(start, _DECLARED, 1), F.lower(F.regexp_extract(start, _DECLARED, 2))
    named = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    declared = F.coalesce(F.try_element_at(named, label), label)
    by_mark = F.when(head == "EFBBBF", "utf-8").when(head.startswith("FEFF"), "utf-16be").when(head.startswith("FFFE"), "utf-16le")
    encoding = F.coalesce(by_mark, F.when(label == "", "utf-8").otherwise(declared))
    error = F.when(by_mark.isNull() & (version != "") & (version != "1.0"), "UnsupportedVersion").when(~encoding.isin(*KNOWN), "UnsupportedEncoding")
    return F.struct(F.when(error.isNull(), encoding).alias("encoding"), error.alias("error"))


def _decode(data: pd.Series, encoding: pd.Series) -> pd.DataFrame:
    out = []
    for b, name in zip(data, encoding, strict=True):
        if b is None or name is None:
            out.append((None, None))
            continue
        try:
            out.append((bytes(b).decode(name), False))
        except UnicodeDecodeError:
            out.append((bytes(b).decode(name, "replace"), True))
    return pd.DataFrame(out, columns=["text", "had_errors"])


def decode(data: Column, known: Column | None = None) -> Column:
    """struct<text, had_errors>: the decoded bytes without a byte order mark; null text where the encoding
    is not supported. A known encoding goes before what the bytes say."""
    name = F.coalesce(known, guess(data)["encoding"]) if known is not None else guess(data)["encoding"]
    got = F.pandas_udf(_decode, "text string, had_errors boolean")(data, name)
    return F.struct(F.regexp_replace(got["text"], "\\A\ufeff", "").alias("text"), got["had_errors"].alias("had_errors"))
