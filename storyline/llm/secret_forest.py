"""Secret scans: candidates by pattern, false positives removed by a random forest.

A wide net takes every long run of key-like characters with a digit, and every value
assigned to a credential word. The forest then judges each candidate by its length,
the transitions between its characters, how much of it dictionary words cover, the
path or address it stands in, and the words beside it. It is trained on labelled
findings, which :func:`labelled_findings` makes out of known formats inside sentences
of the corpus' own words; callers with findings of their own pass those instead.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm.common import unused

#: Words that name credentials, and words beside harmless identifiers.
CREDENTIAL_WORDS = "password passwd pwd token secret apikey api_key access_key auth credential private_key".split()
HARMLESS_WORDS = "commit sha sha1 sha256 md5 uuid guid id hash build version revision checksum digest etag order invoice isbn card".split()
PLACEHOLDER_WORDS = "your example sample changeme placeholder xxxx dummy redacted insert enter".split()

MIN_LENGTH = 16
ASSIGNED = re.compile(
    r"(?i)(?<![a-z])(pass(?:word|wd)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth|credential)"
    r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<value>[^\s\"',;<>(){}]{6,})"
)
RUN = re.compile(r"[A-Za-z0-9_+/=\-]{16,}")
ASSIGN_PREFIX = re.compile(r"[A-Za-z_\-]{2,32}=+(?=.)")
WORD = re.compile(r"[a-zA-Z]{4,}")
NEAR = re.compile(r"[A-Za-z0-9_]+")
MASK = "<SECRET>"
#: Words of the dictionary and the training sentences.
DICTIONARY_WORDS = 5000
TRAIN_EACH = 250
THRESHOLD = 0.5

FEATURES = (
    "length digits upper lower symbols entropy hex changes lower_digit upper_digit vowel_pairs covered words repeats "
    "slashes dotted scheme dashes credential harmless placeholder assigned quoted aws_like"
).split()


@dataclass(frozen=True)
class Dictionary:
    words: frozenset[str]

    def covered(self, text: str) -> tuple[int, int]:
        """Characters of letter runs that are dictionary words or made of them, and words found."""
        total = found = 0
        for match in WORD.finditer(text):
            run = match.group().lower()
            at = 0
            while at < len(run):
                size = next((n for n in range(min(14, len(run) - at), 3, -1) if run[at : at + n] in self.words), 0)
                total, found = total + size, found + bool(size)
                at += size or 1
        return total, found


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what may be a secret; overlaps go to the earlier, longer one."""
    if not text:
        return []
    spans = [(m.start("value"), m.end("value"), "assigned") for m in ASSIGNED.finditer(text)]
    for m in RUN.finditer(text):
        start, value = m.start(), m.group()
        prefix = ASSIGN_PREFIX.match(value)
        if prefix:
            start, value = start + prefix.end(), value[prefix.end() :]
        value = value.rstrip("=") if len(value) > MIN_LENGTH else value
        if len(value) >= MIN_LENGTH and any(c.isdigit() for c in value):
            spans.append((start, m.end(), "run"))
    out: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end, kind))
    return out


def features(text: str, start: int, end: int, dictionary: Dictionary) -> list[float]:
    """The forest's view of one candidate; looks at 40 characters on either side."""
    value = text[start:end]
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    n = len(value)
    counts = Counter(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    pairs = Counter(zip(kinds, kinds[1:]))
    share = Counter(kinds)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    covered, words = dictionary.covered(value)
    vowels = sum(a.lower() in "aeiou" and b.isalpha() and b.lower() not in "aeiou" for a, b in zip(value, value[1:]))
    near = [w.lower() for w in NEAR.findall(before)[-3:]] + [w.lower() for w in NEAR.findall(after)[:1]]
    low = value.lower()
    return [
        float(n), share["d"] / n, share["u"] / n, share["l"] / n, share["s"] / n, entropy,
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        sum(k for (a, b), k in pairs.items() if a != b) / n,
        (pairs["l", "d"] + pairs["d", "l"]) / n, (pairs["u", "d"] + pairs["d", "u"]) / n,
        vowels / n, covered / n, float(words), max(counts.values()) / n,
        float(value.count("/") + before[-1:].count("/")), float(after[:1] == "." and after[1:2].isalnum()),
        float("://" in before.rsplit(" ", 1)[-1] or "://" in value), float(value.count("-") + value.count("_")),
        float(any(w in CREDENTIAL_WORDS for w in near)), float(any(w in HARMLESS_WORDS for w in near)),
        float(any(w in low for w in PLACEHOLDER_WORDS)), float(before.rstrip(" \"'")[-1:] in "=:" and before != ""),
        float(before[-1:] in "\"'" and before != ""), float(bool(re.fullmatch(r"(AKIA|ASIA)[0-9A-Z]{16}", value))),
    ]


def labelled_findings(words: list[str], each: int = TRAIN_EACH, seed: int = 17) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): known formats, harmless look-alikes, between corpus words."""
    rng = random.Random(seed)
    words = words or ["word"]
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, mixed = digit + "abcdef", low + up + digit
    word = lambda: rng.choice(words)
    some = lambda n: [word() for _ in range(n)]
    named = lambda: rng.choice(["password", "token", "secret", "api_key", "access_key", "passwd", "pwd"])
    secret = [
        lambda: ("", pick(["AKIA", "ASIA"], 1) + pick(up + "234567", 16), ""),
        lambda: (f'{named()} = "', pick(hexa, rng.choice([32, 40, 64])), '"'),
        lambda: (f"{named()}=", pick(hexa, rng.randint(16, 24)), ""),
        lambda: (f"{named()}: ", pick(mixed, rng.randint(12, 40)), ""),
        lambda: (f'{named()} = "', pick(mixed + "+/", rng.randint(20, 44)), '"'),
        lambda: ("", rng.choice(["ghp_", "sk-", "xoxb-", "glpat-"]) + pick(mixed, rng.randint(24, 40)), ""),
        lambda: (f"{named()}={word()}", pick(mixed + "!@#", rng.randint(10, 20)), ""),
    ]
    harmless = [
        lambda: (f"{rng.choice(HARMLESS_WORDS)} ", pick(hexa, rng.choice([32, 40, 64])), ""),
        lambda: (f"{rng.choice(HARMLESS_WORDS)}: ", pick(hexa, rng.choice([16, 20, 40])), ""),
        lambda: ("", "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), ""),
        lambda: ("", pick(digit, rng.randint(16, 19)), ""),
        lambda: ("/", "/".join([*some(3), word() + pick(digit, rng.randint(1, 4))]), ".html"),
        lambda: ("https://example.com/", "-".join([*some(4), pick(digit, rng.randint(1, 6))]), ""),
        lambda: ("", "_".join([*some(3), pick(digit, 2)]), ""),
        lambda: ("", "".join(w.capitalize() for w in some(4)) + pick(digit, rng.randint(1, 3)), ""),
        lambda: ("", pick("=-_", 1) * rng.randint(16, 40) + pick(digit, 1), ""),
        lambda: ("", pick(mixed, 1) * rng.randint(15, 30) + pick(digit, 1), ""),
        lambda: (f"{named()}=", rng.choice(["your_password_here", "changeme123", "xxxxxxxxxxxxxxxx1", "example-token-0001"]), ""),
        lambda: (f"{named()}: ", "".join(some(2)), ""),
        lambda: ("", "2024-" + "-".join(pick(digit, 2) for _ in range(5)), ""),
        lambda: ("", "".join(some(3)) + pick(digit, rng.randint(1, 2)) + word(), ""),
    ]
    out = []
    for label, makers in ((1, secret), (0, harmless)):
        for make in makers:
            for _ in range(each):
                prefix, value, suffix = make()
                lead = " ".join(some(rng.randint(0, 8)))
                head = f"{lead} {prefix}" if lead else prefix
                tail = rng.choice(["", ".", " "]) + " ".join(some(rng.randint(0, 5)))
                out.append((head + value + suffix + (" " + tail if tail.strip(". ") else tail), len(head), len(head) + len(value), label))
    return out


def corpus_words(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """Most frequent words of all documents; ties go by the word."""
    found = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w").between(4, 14))
    top = found.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words)
    return [r.w for r in top.collect()]


def train(spark: SparkSession, findings: list[tuple[str, int, int, int]], dictionary: Dictionary, seed: int = 17) -> RandomForestClassificationModel:
    """A forest over labelled findings; their number is bounded by the caller."""
    rows = [(features(t, a, b, dictionary), float(label)) for t, a, b, label in findings]
    frame = spark.createDataFrame(rows, "f array<double>, label double").repartition(2)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=40, maxDepth=8, seed=seed)
    return forest.fit(frame.select(array_to_vector("f").alias("features"), "label"))


def scored_candidates(docs: DataFrame, model: RandomForestClassificationModel, dictionary: Dictionary, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, start, end, kind, score, secret) of every candidate of every text.

    Places are code points. Null and empty texts have none; repeated rows have theirs
    repeated; other columns are not read.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(dictionary)  # DICTIONARY_WORDS words
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = broadcast.value
        for batch in batches:
            at, out = [], [[], [], [], []]
            for n, text in enumerate(batch.column(2).to_pylist()):
                for start, end, kind in candidates(text):
                    at.append(n)
                    for column, value in zip(out, (start, end, kind, features(text, start, end, words))):
                        column.append(value)
            at = pa.array(at, pa.int32())
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                ["doc_id", "text_hash", "start", "end", "kind", "f"],
            )

    found = rows.mapInArrow(run, f"doc_id {kind_of_id}, text_hash long, start long, end long, kind string, f array<double>")
    judged = model.transform(found.withColumn("features", array_to_vector("f")))
    score = vector_to_array("probability")[1]
    return judged.select("doc_id", "text_hash", "start", "end", "kind", score.alias("score"), (score >= threshold).alias("secret"))


def redact(docs: DataFrame, found: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret of ``found`` replaced by ``mask`` in ``text``.

    Columns stay, whatever their names; rows of one id and text are masked alike, a null
    text stays null. The text is cut at the secrets once and put together again, so the
    work is in proportion to its length.
    """
    key, text_hash, places = (unused(docs.columns, name) for name in ("_id", "_hash", "_spans"))
    spans = found.where("secret").groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias(places)
    ).select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash), places)
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(text_hash)), "left")
    # the stretch before each secret, and the rest behind the last one
    before = F.transform(places, lambda s, n: F.substring(
        F.col("text"),
        F.when(n > 0, F.get(F.col(places), n - 1)["end"]).otherwise(F.lit(0)).cast("int") + 1,
        (s["start"] - F.when(n > 0, F.get(F.col(places), n - 1)["end"]).otherwise(F.lit(0))).cast("int"),
    ))
    rest = F.substring(F.col("text"), F.element_at(places, -1)["end"].cast("int") + 1, F.lit(2**31 - 1))
    clean = F.array_join(F.concat(before, F.array(rest)), mask)
    return joined.withColumn("text", F.when(F.col(places).isNotNull(), clean).otherwise(F.col("text"))).drop(key, text_hash, places)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scored candidates under a forest trained with the corpus' own words.

    As :func:`scored_candidates`: null and empty texts have none, repeated rows have
    theirs repeated, other columns are not read; an empty table gives no rows. Ties of
    the dictionary go by the word, so the same table gives the same scores.
    """
    words = corpus_words(docs)
    dictionary = Dictionary(frozenset(words))
    model = train(docs.sparkSession, labelled_findings(words), dictionary)
    return scored_candidates(docs, model, dictionary, threshold)
