"""Secret scans: candidates by pattern, false positives removed by a random forest, without Python on the executors.

Candidates are quoted or assigned values after a credential word, private key blocks, passwords in addresses, values
with a well-known prefix, and runs of 16 or more key characters with a digit; none has an upper length. The forest
sees a candidate's length, character transitions (class pairs, and letter pairs against a dictionary), dictionary
coverage, hashed parts of the path and hashed neighbouring words. It learns from a table of labelled findings
(columns as ``candidates`` returns them, and ``label``). The dictionary is the most frequent words of a vocabulary
file, whose path is a parameter; the driver reads it.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hashed_set, table

# Patterns.
CUES = r"tokens?|secrets?|passw(?:or)?d|passphrase|pwd|api[_-]?key|(?:access|private|signing|encryption)[_-]?key|auth(?:orization)?|bearer|credentials?"
PREFIXES = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}+|sk_live_[A-Za-z0-9]{16,}+|xox[abps]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+"
)
KEY_BLOCK = r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY[A-Z ]*+-----(?:[^-]|-(?!----))*+(?:-----END [A-Z0-9 ]*+-----)?+"
CUE = rf"(?=[TtSsPpAaEeBbCc])(?i:{CUES})[A-Za-z0-9_-]*+"
SIGN = r"[\x22'`\])]*+[ \t]*+(?:=>|:=|[:=])[ \t]*+"
ASSIGNED = (
    rf"({CUE}{SIGN}(?:(?i:bearer|basic|token)[ \t]++)?+[\x22'`]?+)"
    r"((?<=\x22)[^\x22\r\n]{6,}+(?=\x22)|(?<=')[^'\r\n]{6,}+(?=')|(?<=`)[^`\r\n]{6,}+(?=`)|[^\s\x22'`,;(){}\[\]<>]{6,}+)"
)
ADDRESS = r"(://[^\s:/@\x22']*+:)([^\s/@\x22']++)(?=@)"
#: A run of up to 64 that holds a cue and stands before a sign is the name of what is assigned.
LONG_RUN = (
    r"((?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])"
    rf"(?!(?=[A-Za-z0-9+/_-]{{1,64}}+{SIGN})[A-Za-z0-9+/_-]*?(?i:{CUES}))[A-Za-z0-9+/_-]{{16,}}+={{0,2}}+)"
)
#: Groups 2, 4, 5 and 6 are values; 1 and 3 stand before them in the match; 7 is a name without a value, which is passed over.
CANDIDATE = rf"{ASSIGNED}|{ADDRESS}|({KEY_BLOCK}|{PREFIXES})|{LONG_RUN}|({CUE})"
HIT, VALUE = "\ue000", "\ue001"
PLACEHOLDERS = r"example|sample|dummy|changeme|placeholder|redacted|your[_ -]|xxxx|\*\*\*\*|1234567|abcdef0?123|^\$|^%|^<|todo|insert"
HASH_WORDS = r"sha-?(?:1|2|256|512)|md5|hash|digest|checksum|commit|revision|fingerprint|integrity|base64|etag"
ID_WORDS = r"(?:[_-]|\b)(?:u?uid|id|url|uri|path|file|name|count|ttl|type|size)[\x22'`]?\s*[:=]?[\s\x22'`]*$"
CLASSES = "ludo"  # lower, upper, digit, other
NUMBERS = ["length", "natural", "distinct", "digits", "uppers", "hex", "covered", "placeholder", "prefixed", "block", "cue_before",
           "assigned", "quoted", "called", "hash_near", "id_near", "words_before", "spaces", "decimal_only", "uuid"] + [a + b for a in CLASSES for b in CLASSES]
NEAR_WORDS, PATH_PARTS = 64, 32
CONTEXT = 80
TREES, DEPTH, SEED = 30, 8, 3
#: Rows of the built-in table of labelled findings.
LABELLED_ROWS = 6000
DICTIONARY_WORDS = 8000
VOCABULARY = "word_bpe_49k.json"


def dictionary(path: str | None = None, most: int = DICTIONARY_WORDS) -> list[str]:
    """The first whole words of four letters or more of a vocabulary, which lists the frequent ones first."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return [m[1] for w in sorted(vocabulary, key=vocabulary.get) if (m := re.fullmatch("([a-z]{4,})</w>", w))][:most]


def letter_pairs(words: list[str]) -> Column:
    """A constant array of 27 x 27 log probabilities: the second letter after the first, in words; 26 is no letter."""
    at = lambda c: ord(c) - 97 if "a" <= c <= "z" else 26
    pairs = Counter((at(a), at(b)) for w in words for a, b in zip(f" {w}", f"{w} ", strict=True))
    rows = Counter()
    for (a, _), n in pairs.items():
        rows[a] += n
    logs = [math.log((pairs[a, b] + 0.5) / (rows[a] + 13.5)) for a in range(27) for b in range(27)]
    return F.split(F.lit(",".join(f"{x:.4f}" for x in logs)), ",").cast("array<double>")


def running(lengths: Column) -> Column:
    """The sum of the lengths before each; in blocks, so that long arrays are not copied for each of their entries."""
    size = 512
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / size).cast("int")), lambda b: F.slice(lengths, b * size + 1, F.lit(size)))
    none = F.array().cast("array<bigint>")

    def sums(start: Column, values: Column) -> Column:
        first = F.struct(start.cast("long").alias("at"), none.alias("out"))
        return F.aggregate(values, first, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x))
    starts = sums(F.lit(0), totals)
    return F.flatten(F.transform(blocks, lambda b, i: sums(F.get(starts, i), b)))


def candidates(files: DataFrame, pattern: str = CANDIDATE) -> DataFrame:
    """doc_id, path, start (characters before it), value, before, after: every candidate of every whole text.

    One pass of the pattern marks the hits, and the text is split at the marks; the two characters used as marks,
    which are private ones, count as blanks where the text has them.
    """
    marked = F.regexp_replace(F.translate("text", HIT + VALUE, "  "), F.lit(pattern), F.lit(f"{HIT}$1$3$7{VALUE}$2$4$5$6{HIT}"))
    hit = files.select("doc_id", "path", F.split(marked, HIT, -1).alias("parts")).where(F.size("parts") > 1)
    # Even parts are gaps, odd ones are hits: the head, a mark, and the value.
    lengths = F.transform("parts", lambda x, i: (F.length(x) - i % 2).cast("long"))
    hit = hit.withColumn("starts", running(lengths))
    part = lambda i: F.translate(F.coalesce(F.get("parts", i), F.lit("")), VALUE, "")
    head = lambda x: F.substring_index(x, VALUE, 1)

    def one(k: Column) -> Column:
        x = F.get("parts", 2 * k + 1)
        before = F.concat(F.right(part(2 * k - 1), F.lit(CONTEXT)), F.right(F.get("parts", 2 * k), F.lit(CONTEXT)), head(x))
        after = F.concat(F.substring(F.get("parts", 2 * k + 2), 1, CONTEXT), F.substring(part(2 * k + 3), 1, CONTEXT))
        return F.struct(
            (F.get("starts", 2 * k + 1) + F.length(head(x))).alias("start"), F.substring_index(x, VALUE, -1).alias("value"),
            F.right(before, F.lit(CONTEXT)).alias("before"), F.substring(after, 1, CONTEXT).alias("after"),
        )

    hits = F.transform(F.sequence(F.lit(0), F.floor(F.size("parts") / 2).cast("int") - 1), one)
    return hit.select("doc_id", "path", F.explode(hits).alias("c")).select("doc_id", "path", "c.*").where("value <> ''")


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """found with the forest's inputs: NUMBERS, every one a double, and the arrays near_words and path_parts."""
    v, low = F.col("value"), F.lower("value")
    chars = F.length(v)
    share = lambda cls: F.regexp_count(v, F.lit(f"[{cls}]")) / chars
    kinds = reduce(lambda s, x: F.regexp_replace(s, x[0], x[1]), [("[a-z]", "l"), ("[A-Z]", "u"), ("[0-9]", "d"), ("[^lud]", "o")], v)
    known, pairs, longest = hashed_set(words), letter_pairs(words), max(map(len, words), default=0)

    def covered(word: Column) -> Column:
        """Whether the letters are a word or two words; no two words are longer than twice the longest."""
        n = F.length(word)
        cuts = F.when(n.between(8, 2 * longest), F.sequence(F.lit(4), n - 4)).otherwise(F.array().cast("array<int>"))
        return known(word) | F.exists(cuts, lambda k: known(F.substring(word, F.lit(1), k)) & known(F.substring(word, k + 1, n - k)))

    pieces = F.regexp_extract_all("value", F.lit("[A-Z]?[a-z]{4,}|[A-Z]{4,}"), F.lit(0))
    in_words = F.aggregate(F.filter(F.transform(pieces, F.lower), covered), F.lit(0), lambda s, x: s + F.length(x))
    letters = F.transform(F.split(low, ""), lambda x: F.when(x.between("a", "z") & (F.length(x) == 1), F.ascii(x) - 97).otherwise(26))
    logs = F.transform(F.array(letters), lambda a: F.transform(a, lambda x, i: F.get(pairs, x * 27 + F.coalesce(F.get(a, i + 1), F.lit(26)))))[0]
    near = F.lower(F.right(F.col("before"), F.lit(40)))
    columns = {
        "length": F.log1p(chars.cast("double")),
        "natural": F.try_divide(F.aggregate(logs, F.lit(0.0), lambda s, x: s + x), chars),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(chars, F.lit(64)),
        "digits": share("0-9"),
        "uppers": share("A-Z"),
        "hex": v.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        "covered": in_words / chars,
        "placeholder": low.rlike(PLACEHOLDERS),
        "prefixed": v.rlike(f"^(?:{PREFIXES})"),
        "block": v.rlike("^-----BEGIN"),
        "cue_before": near.rlike(CUES),
        "assigned": near.rlike(r"[:=]\s*(?:(?:bearer|basic|token)\s+)?[\x22'`]?$"),
        "quoted": near.rlike(r"[\x22'`]$") & F.col("after").rlike(r"^[\x22'`]"),
        "called": F.col("after").rlike(r"^[(\[{.]"),
        "hash_near": near.rlike(HASH_WORDS) | low.rlike(f"^(?:{HASH_WORDS})[-:_]"),
        "id_near": near.rlike(ID_WORDS),
        "words_before": F.size(F.filter(F.split(near, r"[^\p{L}]+"), lambda x: F.length(x) > 1)),
        "spaces": F.regexp_count(v, F.lit(r"\s")) / chars,
        "decimal_only": v.rlike("^[0-9]+$"),
        "uuid": low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    }
    columns |= {a + b: F.regexp_count("__kinds", F.lit(f"{a}(?={b})")) / chars for a in CLASSES for b in CLASSES}
    parts = lambda text: F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda x: x != "")
    around = F.concat(F.transform(parts(F.right(F.col("before"), F.lit(40))), lambda x: F.concat(F.lit("<"), x)), F.transform(parts(F.substring("after", 1, 20)), lambda x: F.concat(F.lit(">"), x)))
    found = found.withColumn("__kinds", kinds).withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in columns.items()})
    return found.withColumns({"near_words": around, "path_parts": parts(F.col("path"))}).drop("__kinds")


def labelled_findings(spark: SparkSession, rows: int = LABELLED_ROWS, words: list[str] | None = None) -> DataFrame:
    """Labelled findings made by rule, as many of each kind: values that are secrets, and values that look like them."""
    i = F.col("id")
    hashed = lambda salt: F.sha2(F.concat(F.lit(f"finding {salt}:"), i.cast("string")), 256)
    pick = lambda choice, salt: F.get(F.array(*map(F.lit, choice)), F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(choice))).cast("int"))
    said = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    words = words or dictionary()
    every = F.split(F.lit(" ".join(words)), " ")
    any_word = lambda *salt: F.get(every, F.pmod(F.xxhash64(i, *salt), F.lit(len(words))).cast("int"))

    def prose(salt: int, most: int) -> Column:
        """None or some words of the dictionary."""
        n = F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(most + 1)).cast("int")
        return F.array_join(F.transform(F.slice(F.sequence(F.lit(1), F.lit(most)), F.lit(1), n), lambda k: any_word(F.lit(salt), k)), " ")

    base64 = lambda salts: F.base64(F.unhex(F.concat(*[hashed(x) for x in salts])))
    parts = {"word": any_word(F.lit(3)), "other": any_word(F.lit(4)), "third": any_word(F.lit(5)), "hex64": hashed("a"), "plain": base64("fghi"),
             "tail": F.conv(F.substring(hashed("b"), 1, 6), 16, 10), "base": F.regexp_replace(base64("cde"), "[+/=]", pick(["-", "_", "A", "9"], 8)),
             "cue": pick(["token", "secret", "password", "api_key", "access-key", "passwd", "client_secret", "private_key", "auth_token", "credential", "apiKey"], 1),
             "noun": pick(["number", "order", "build", "commit", "see", "the", "revision", "id", "on", "y", "une", "der", "file", "version"], 2),
             "sign": pick([" = ", "=", ": ", " := ", ' => "', "    = "], 6), "prose_before": prose(40, 7), "prose_after": prose(41, 4)}
    made = spark.range(rows).select("id", *[v.alias(k) for k, v in parts.items()])
    word, other, third, hex64, plain, tail, base, cue, noun, sign = map(F.col, list(parts)[:10])
    quoted, open_ = said(cue, pick([" = ", "=", ": ", " := ", "   = "], 6), '"'), said(cue, pick(["=", ": ", " = "], 7))
    cut_to = lambda x, salt, low, high: F.substring(x, F.lit(1), pick(range(low, high), salt))
    uuid = F.regexp_replace(F.substring(hex64, 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    shut, space, line = F.lit('" '), F.lit(" "), F.lit("\n")
    secrets = [  # value, what stands before, and what after
        (F.substring(hex64, 1, 40), quoted, shut), (F.substring(hex64, 1, 32), quoted, shut), (hex64, said(F.upper(cue), "="), line),
        (cut_to(base, 10, 20, 64), quoted, shut), (cut_to(base, 11, 16, 44), open_, line), (F.upper(F.substring(hex64, 1, 40)), said(F.upper(cue), sign), line),
        (said("AKIA", F.upper(F.substring(hex64, 1, 16))), said(noun, " "), space), (said("ghp_", F.substring(base, 1, 36)), said(noun, " "), space),
        (said("sk_live_", cut_to(base, 12, 24, 40)), quoted, shut), (said(word, tail, pick(["!", "#", "$", ""], 13)), quoted, shut),
        (said(word, other), said(pick(["password", "pwd", "passwd", "passphrase"], 14), pick([": ", "=", " = "], 7)), line),
        (said(word, F.substring(tail, 1, 2)), said(pick(["password", "pwd", "DB_PASSWORD", "passwd"], 15), pick(["=", ": "], 7)), line),
        (said("eyJhbGciOi", F.substring(base, 1, 20), ".eyJ", F.substring(base, 21, 40), ".", F.substring(base, 61, 43)), F.lit("Authorization: Bearer "), line),
        (said("-----BEGIN ", pick(["RSA ", "EC ", ""], 16), "PRIVATE KEY-----\n", plain, "\n", plain, "\n-----END PRIVATE KEY-----"), said(noun, "\n"), line),
        (cut_to(base, 17, 8, 24), said(pick(["postgres", "mysql", "amqp", "https"], 18), "://", word, ":"), said("@", other, ".internal")),
        (F.concat(*[F.concat(hashed(f"l{k}"), plain) for k in range(4)]), quoted, shut), (said(word, " ", other, " ", third, " ", tail), quoted, shut),
        (F.concat(plain, plain), said('"', cue, '": "'), shut),
    ]
    others = [
        (cut_to(F.translate(hex64, "abcdef", "012345"), 10, 16, 24), said(word, " ", noun, " "), space), (F.substring(hex64, 1, 40), said(noun, " "), space),
        (hex64, said(pick(["sha256:", "digest: ", "checksum = ", "sha256 "], 20)), line), (said("sha512-", plain), F.lit('"integrity": "'), F.lit('",')),
        (said(word, "_", other, "_v2_", third), quoted, shut), (said("your-", cue, "-1234567"), quoted, shut), (said(word, "/", other, "/", third, "2/", word), said(noun, " "), space),
        (said("example_", F.substring(hex64, 1, 12)), quoted, shut), (F.repeat(F.lit("x1"), 12), quoted, shut), (uuid, said(pick(["request ", "trace id: ", "uuid = \"", "id: "], 21)), space),
        (uuid, said(cue, pick(["_id: ", "_request_id = ", "Id: "], 22)), line), (hex64, said(cue, pick(["_hash = \"", "_checksum: \"", "_digest: \"", "_fingerprint = \""], 23)), shut),
        (F.substring(hex64, 1, 40), said(cue, pick(["_commit: ", "_sha1: ", "_revision = "], 24)), line), (F.concat(plain, plain, plain), F.lit("data:image/png;base64,"), F.lit('"')),
        (F.concat(*[plain] * 6), said('src="data:image/gif;base64,'), F.lit('"')), (said("${", F.upper(word), "_", F.upper(cue), "}"), quoted, shut),
        (said("get_", word, "_", other), said(cue, " = "), F.lit("(")), (said("os.environ.", word), said(cue, " = "), F.lit("[")), (word, said(cue, ": "), pick([" ", "\n", ", "], 25)),
        (pick(["string", "required", "Optional", "boolean", "disabled", "undefined", "nullable"], 26), said(cue, ": "), pick(["[str]", "\n", ",", ")"], 27)),
        (said("content/", word, "/2021/05/", other, "-", F.substring(tail, 1, 3)), said("http://www.", third, ".com/"), space),
        (said(word, "-", F.substring(hex64, 1, 12), "-", other), said(noun, " "), F.lit(".js")), (said(word, F.initcap(other), "Utf8To", F.initcap(third)), said(noun, " "), F.lit("(")),
        (said("MAX_", F.upper(word), "_", F.upper(other), "_1024"), said(noun, " "), space), (F.rpad(tail, 7, "0"), said(cue, "s: "), line),
        (pick(["********", "<your token here>", "changeme123", "xxxxxxxxxxxx", "TODO insert later"], 28), quoted, shut), (said(word, " ", other, " ", third), said(cue, pick([": \"", " = \""], 7)), F.lit('"),')),
        (said("/", word, "/", other, "/", third), said(cue, "_path = \""), shut), (said("https://", word, ".example.com/", other), said(cue, "_url = \""), shut),
        (F.substring(plain, 1, 64), said(noun, " "), space),
    ]
    places = ["src/%s.py", "config/%s.env", "deploy/%s.yaml", "src/%s/settings.py", "src7", "src12", "docs/%s.md", "%s/main.js"]
    quiet = [*places, "tests/%s.py", "web/%s.html", "package-lock.json", "fixtures/%s.json"]
    where = lambda names, salt: F.regexp_replace(pick(names, salt), "%s", word)
    kinds = [(1.0, where(places, 30), *x) for x in secrets] + [(0.0, where(quiet, 31), *x) for x in others]
    case, chosen = F.pmod(i, F.lit(len(kinds))), None
    for k, (y, p, v, b, a) in enumerate(kinds):  # a case's expressions are evaluated for its own rows only
        finding = F.struct(v.alias("value"), b.alias("before"), a.alias("after"), p.alias("path"), F.lit(y).alias("label"))
        chosen = chosen.when(case == k, finding) if k else F.when(case == k, finding)
    made = made.select(chosen.alias("c"), "prose_before", "prose_after")
    around = [F.concat_ws(" ", "prose_before", "c.before").alias("before"), F.concat("c.after", F.col("prose_after")).alias("after")]
    return made.select("c.value", *around, "c.path", "c.label")


def train_forest(labelled: DataFrame, words: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> PipelineModel:
    """A forest over the findings' features. labelled: value, before, after, path, label (0 or 1)."""
    near = HashingTF(inputCol="near_words", outputCol="__near", numFeatures=NEAR_WORDS, binary=True)
    parts = HashingTF(inputCol="path_parts", outputCol="__parts", numFeatures=PATH_PARTS, binary=True)
    assembler = VectorAssembler(inputCols=[*NUMBERS, "__near", "__parts"], outputCol="__features")
    forest = RandomForestClassifier(
        featuresCol="__features", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird",
        seed=seed, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y"
    )
    rows = cut(PipelineModel([near, parts, assembler]).transform(with_features(labelled, words)).select("__features", "label"))
    return PipelineModel([near, parts, assembler, forest.fit(rows)])


def scan_secrets(
    files: DataFrame, labelled: DataFrame | None, threshold: float = 0.5, words: list[str] | None = None, model: PipelineModel | None = None
) -> DataFrame:
    """Every candidate of files: doc_id, path, start, length, value, probability, is_secret.

    files: doc_id, path, text; other columns are ignored. labelled: findings with both labels, unused where a
    trained model is given. words: the dictionary. start counts characters from 0. A text without a candidate, a null or empty one gives no rows; a
    null path and a null doc_id are kept as null. Values of any length are candidates, whole. Repeated rows each
    give their findings. An empty files gives no rows. A candidate found several times in a text is a finding each
    time.
    """
    words = dictionary() if words is None else words
    model = model or train_forest(labelled, words)
    scored = model.transform(with_features(candidates(files.select("doc_id", "path", "text")), words))
    p = F.round(vector_to_array("__p")[1], 6)
    return scored.select(
        "doc_id", "path", "start", F.length("value").cast("long").alias("length"), "value", p.alias("probability"), (p >= threshold).alias("is_secret")
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every whole text of documents; the source stands for the path. Edges: see ``scan_secrets``."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), "text")
    return scan_secrets(files, labelled_findings(spark))
