import random
import re
import zlib

from pyspark.sql import functions as F

from billweave.llm import secret_scan as s
from helpers import LONG, documents

ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(s.ACCESS, text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(s.HEX, text) if len(m[0]) >= 24]
    return [(s.BASE[k], a, b) for a, k, b in sorted(found)]


def test_base_kinds_like_plain_regular_expressions():
    r, scanner = random.Random(3), s.Scanner()
    pieces = ["password", "Token", "api", "_", "key", "=", ":", " ", '"', "a", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP",
              "0123456789ab", "f", "SECRET", "\u212a", "ſ", "É", "passwd", "akia", "😀", "\n"]
    for _ in range(20_000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 15)))
        assert [x for x in scanner.spans(text) if x[0] in s.BASE] == base_spans(text), text


def test_checksums(spark):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = "ghp_" + body + s.base62(zlib.crc32(body.encode()), 6)
    kinds = {t: [k for k, _, _ in s.Scanner().spans(t)] for t in (
        good, good[:-1] + ("x" if good[-1] != "x" else "y"), "IBAN: DE89 3704 0044 0532 0130 00",
        "IBAN: DE88 3704 0044 0532 0130 00", "Card no. 4111 1111 1111 1111", "card 4111 1111 1111 1112",
        "4111 1111 1111 1111")}
    assert list(kinds.values()) == [["forge"], [], ["iban"], [], ["card"], [], []]


def test_numbers_with_something_after_them(spark):
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    secret = {f"card {card} 12/26": f"card {card}", f"card {card}-123": f"card {card}", f"VISA: {card} 7": f"VISA: {card}",
              f"card 4111111111111111 1226 9": "card 4111111111111111", f"card {card}12": None,
              f"IBAN {iban} BIC COBADEFFXXX": f"IBAN {iban}", f"IBAN {iban} 12 AB": f"IBAN {iban}",
              f"IBAN: {iban.replace(' ', '')}BICCOBADEFFXXX1": f"IBAN: {iban.replace(' ', '')}",
              f"IBAN XX35 ABCD EFGH IJKL MNOP QR": None, "IBAN DE88 3704 0044 0532 0130 00 BIC COBADEFFXXX": None,
              f"IBAN GB82 WEST 1234 5698 7654 32 SORT 1": "IBAN GB82 WEST 1234 5698 7654 32",
              f"card {card} 12/26, IBAN {iban} BIC": f"card {card}"}
    for text, part in secret.items():
        found = s.Scanner().spans(text)
        assert [text[a:b] for _, a, b in found][:1] == ([part] if part else []), text
    docs = documents(spark, [f"pay by card {card} 12/26 or IBAN {iban} BIC COBADEFFXXX now"])
    assert s.redact(s.scan(docs)).first().text == "pay by [SECRET] 12/26 or [SECRET] BIC COBADEFFXXX now"


def test_scan_and_redact(spark):
    texts = ["x token = \"abcdef0123456789abcdef01\" y", None, "", "clean", "é " * 5 + "AKIA" + "Q" * 16, LONG + " secret=abcdefg",
             "password: abc", "x token = \"abcdef0123456789abcdef01\" y"]
    docs = documents(spark, texts).withColumn("secrets", F.lit("mine"))
    found = s.scan(docs)
    rows = found.select("*", s.spans_text(F.col("secrets")).alias("t")).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r.secrets] for r in rows] == [base_spans(t or "") for t in texts]
    assert rows[0].t == "assign:2:35,hex:11:35" and rows[1].t == ""
    clean = [r.text for r in s.redact(found).orderBy("doc_id").collect()]
    assert clean[0] == "x [SECRET]\" y" and clean[1:4] == [None, "", "clean"] and clean[5] == LONG + " [SECRET]"
    assert s.scan(docs.limit(0)).count() == 0
