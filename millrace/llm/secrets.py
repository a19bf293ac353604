"""Secret scans: candidate tokens by pattern, false positives removed by a random forest, in DataFrame operations only.

A candidate is the block of a private key, the password of an address with a login, a run of at least twelve token
characters with a digit in it, a run of at least six characters without blanks and quotes after a secret word, or one
after any assignment. What is none of these (a passphrase with blanks, a short or merely lettered token that nothing
announces, one split over lines) the forest never sees. It sees a candidate's length, its changes of character class, its
make-up, how much of it dictionary words cover, whether it stands in a path, and the words around it. It is trained on
labelled findings and becomes a sum of nested conditions, so scoring stays in the query's plan.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise

REPLACEMENT = "[SECRET]"
#: How far a candidate's surroundings are read, in characters before and after.
BEFORE, AFTER = 64, 32
#: Candidates of a text whose places are added up together.
CHUNK = 256
#: The labelled findings number as many as this; trees of the forest, their depth, and the share of trees that makes a secret.
FINDINGS, TREES, DEPTH, VERDICT = 3000, 12, 6, 0.5

# Words that stand before secrets, words that stand around what only looks like one, and a dictionary.
SECRET_WORDS = ["password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "private_key", "credential", "credentials", "auth", "authorization", "bearer", "key"]
PLAIN_WORDS = ["commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "etag", "uuid", "guid", "id", "version", "build", "revision", "file", "image", "isbn", "order", "invoice", "page", "phone", "tel", "fax", "integrity"]
DICTIONARY = [
    "about", "account", "admin", "after", "backup", "base", "build", "cache", "change", "chapter", "class", "client", "code", "config", "content", "copy", "count", "create", "data", "date", "default", "demo", "document", "domain", "dummy", "edit", "email", "error", "event",
    "example", "export", "field", "file", "final", "first", "folder", "form", "function", "group", "header", "here", "home", "image", "import", "index", "info", "input", "item", "label", "level", "library", "list", "local", "login", "mail", "main", "manager", "master", "member",
    "message", "model", "module", "name", "node", "number", "object", "option", "order", "output", "package", "page", "panel", "param", "part", "pass", "password", "path", "phone", "photo", "placeholder", "point", "product", "profile", "project", "public", "query", "record",
    "release", "report", "request", "resource", "response", "result", "sample", "schema", "script", "search", "section", "server", "service", "session", "setting", "site", "source", "stage", "start", "state", "status", "storage", "string", "style", "system", "table", "target",
    "task", "temp", "test", "text", "time", "title", "token", "tool", "type", "update", "upload", "user", "utils", "value", "version", "view", "word", "work", "your",
]

# Runs of token characters; a '=' belongs to one only as padding, not before a value.
_TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|(?:AKIA|ASIA)[0-9A-Z]{16})[A-Za-z0-9+/_-]{12,}+(?:={1,2}+(?![A-Za-z0-9+/_\"'=-]))?+"
_WORDS = "(?i:" + "|".join(SECRET_WORDS) + ")"
_KNOWN = r"(?<![A-Za-z0-9+/_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]|xox[abprs]-|AIza)"
_STOP = r"[.):\]}>]{1,3}+(?:[\s\"',;]|$)"
_SIGN, _QUOTES = r"(?::=|=>|==|[=:])", r"[\"'\]]{0,2}"
#: The value after a secret word, up to a further name=value, a known form or the punctuation at its end.
_ANNOUNCED = rf"(?![=:])(?!(?i:bearer|basic|is)\s)[^\s\"',;](?:(?!{_STOP}|[&?][A-Za-z_-]{{1,40}}+=|{_KNOWN})[^\s\"',;]){{5,}}+"
_ENDS = "(?i:" + "|".join(sorted({w[-3:] for w in SECRET_WORDS})) + ")"
#: A private key from its first line to its last.
_BLOCK = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----\s++(?:[A-Za-z-]{1,24}: [^\n]{0,200}+\s++){0,4}+[A-Za-z0-9+/=\s]++-----END [A-Z ]{0,24}PRIVATE KEY-----"
#: A match is a candidate and, before it, the sign or the gap that announces it (LEAD). Every form begins with a cheap
#: test, so that what looks back at the words before is tried at few places: the password of an address with a login, a
#: value after a secret word and a sign, one after a secret word and a gap, one after any sign up to a run of token
#: characters, and such a run.
CANDIDATE = "|".join([
    _BLOCK,
    r"(?=:)(?<=://[A-Za-z0-9._%+-]{1,40}):[^\s@/:\"'<>]{4,}+(?=@)",
    rf"(?=[:=])(?<={_WORDS}{_QUOTES}\s{{0,3}}){_SIGN}\s{{0,3}}[\"']?{_ANNOUNCED}",
    rf"(?=\s)(?<=[\"'\]]|{_ENDS})(?<={_WORDS}{_QUOTES})\s{{1,3}}(?i:is\s{{1,3}})?[\"']?{_ANNOUNCED}",
    _TOKEN,
    rf"[=:]\s{{0,3}}[\"']?(?!//)(?:(?!{_STOP}|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{12}})[^\s\"'&?=:;,<>(){{}}\[\]]){{6,}}+",
])
LEAD = rf"^(?:{_SIGN}\s{{0,3}}[\"']?|\s{{1,3}}(?i:is\s{{1,3}})?[\"']?)"
#: How keys of known services begin.
_FORMS = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^glpat-[A-Za-z0-9_-]{16,}$|^(?:npm|hf)_[A-Za-z0-9]{30,}$|^sk-[A-Za-z0-9_-]{20,}$|^xox[abprs]-|^AIza[0-9A-Za-z_-]{35}$|^eyJ[A-Za-z0-9_-]{10,}|^-----BEGIN "

# Words of passwords that people choose.
CHOSEN = ["correct", "horse", "battery", "staple", "purple", "tiger", "monkey", "dragon", "hunter", "summer", "winter", "orange", "sunny", "river", "castle", "guitar", "rocket", "coffee", "silver", "falcon", "pepper", "cookie", "shadow", "magic"]

_WORD_SIDE = r"(?i)(?<![A-Za-z])(?:{})(?![A-Za-z])"
FEATURES = ("length", "transitions", "digits", "uppers", "hexadecimal", "distinct", "dictionary", "separators", "path", "assigned", "secret_words", "plain_words", "known_form", "symbols", "named", "name", "login")


def features(c: Column, before: Column, after: Column) -> dict[str, Column]:
    """The forest's inputs, of a candidate and the text on its two sides."""
    size = F.char_length(c)

    def count(pattern: str, of: Column = c) -> Column:
        return F.regexp_count(of, F.lit(pattern))

    changes = count(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]")
    left = size - F.char_length(F.regexp_replace(F.lower(c), "|".join(DICTIONARY), ""))
    near = F.right(before, F.lit(40))
    return {
        "length": size.cast("double"),
        "transitions": changes / size,
        "digits": count("[0-9]") / size,
        "uppers": count("[A-Z]") / size,
        "hexadecimal": F.when(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 1.0).otherwise(0.0),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "dictionary": left / size,
        "separators": count("[/_-]") / size,
        "path": F.when(c.rlike("/[A-Za-z_-]+/") | before.rlike(r"(?:[/\\.~]|://[^\s]*)$") | after.rlike(r"^\.[A-Za-z]{1,5}(?![A-Za-z])") | (F.startswith(after, F.lit("@"))), 1.0).otherwise(0.0),
        "assigned": F.when(before.rlike(r"""[=:]\s*["']?$"""), 1.0).otherwise(0.0),
        "secret_words": count(_WORD_SIDE.format("|".join(SECRET_WORDS)), near).cast("double"),
        "plain_words": (count(_WORD_SIDE.format("|".join(PLAIN_WORDS)), F.right(before, F.lit(24))) + count(_WORD_SIDE.format("|".join(PLAIN_WORDS)), F.left(after, F.lit(12)))).cast("double"),
        "known_form": F.when(c.rlike(_FORMS), 1.0).otherwise(0.0),
        "symbols": count(r"[^A-Za-z0-9+/_=-]") / size,
        "named": F.when(before.rlike(rf"""(?<![A-Za-z]){_WORDS}(?:[_-][A-Za-z0-9_-]{{0,16}})?["'\]]{{0,2}}\s*(?::=|=>|==|[=:])\s*["']?$"""), 1.0).otherwise(0.0),
        "name": F.when(after.rlike(r"""^["']?\s*[=:]|^\("""), 1.0).otherwise(0.0),
        "login": F.when(before.rlike(r"://[^\s:@/]{1,40}:$") & F.startswith(after, F.lit("@")), 1.0).otherwise(0.0),
    }


def labelled_findings(spark: SparkSession, n: int = FINDINGS, first: int = 0) -> DataFrame:
    """(candidate, before, after, secret): findings of known kinds, made by rule from the numbers ``first`` to n - 1."""
    sha = [F.sha2(F.concat_ws(":", F.lit(k), F.col("id")), 256) for k in range(4)]
    b64 = F.regexp_replace(F.base64(F.unhex(F.concat(sha[0], sha[1]))), r"[\r\n=]", "")
    word = [F.get(F.lit(DICTIONARY), F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(DICTIONARY))).cast("int")) for k in range(6)]
    prose = F.get(F.lit([" and then the other ", ". It was in the ", " because of those ", " of the next ", "\n", " he wrote, "]), F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(6)).cast("int"))
    pick = lambda xs, k: F.get(F.lit(xs), F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(xs))).cast("int"))
    some = (F.pmod(F.xxhash64(F.lit(20), "id"), F.lit(30)) + 16).cast("int")
    short = (F.pmod(F.xxhash64(F.lit(21), "id"), F.lit(12)) + 12).cast("int")
    upper = F.substr(F.regexp_replace(F.upper(b64), "[^A-Z0-9]", ""), F.lit(1), F.lit(16))
    number = F.concat(F.lit("1"), F.regexp_replace(F.concat(sha[0], sha[1]), "[a-f]", ""))
    tail = lambda x: F.concat(x, F.lit("7"))  # noqa: E731  a candidate has a digit
    own_word = [F.get(F.lit(CHOSEN), F.pmod(F.xxhash64(F.lit(30 + k), "id"), F.lit(len(CHOSEN))).cast("int")) for k in range(3)]
    year = F.pmod(F.xxhash64(F.lit(40), "id"), F.lit(2100)).cast("string")
    letters = F.substr(F.regexp_replace(b64, "[^A-Za-z]", ""), F.lit(1), (F.pmod(F.xxhash64(F.lit(41), "id"), F.lit(8)) + 7).cast("int"))
    mark = lambda k: pick(["&", "!", ".", "@", "#", "$", "%", "*"], k)
    chosen = ["password=", 'password = "', "passwd: ", "secret: ", "pwd=", "DB_PASSWORD=", "passphrase: '", "db_password: "]
    kinds = [
        (1, pick(["password=", "passwd: ", "pwd=", 'password = "', "password: '", "secret=", "passphrase="], 1), F.substr(sha[0], F.lit(1), some)),
        (1, pick(['token = "', "token: ", "auth_token=", 'secret_key = "', "credential: "], 2), F.substr(sha[0], F.lit(1), F.lit(40))),
        (1, pick(["", "key=", "access_key: ", " id "], 3), F.concat(F.lit("AKIA"), upper)),
        (1, pick(["api_key: ", "apikey=", 'api-key = "', "client_secret=", "token="], 4), tail(F.substr(b64, F.lit(1), some + 8))),
        (1, pick(["Authorization: Bearer ", "bearer ", "token "], 5), F.concat(F.lit("eyJ"), tail(F.substr(b64, F.lit(1), some)))),
        (1, pick(["", "token=", " "], 6), F.concat(F.lit("ghp_"), tail(F.substr(F.regexp_replace(F.concat(b64, b64), "[^A-Za-z0-9]", ""), F.lit(1), F.lit(36))))),
        (1, pick(["password=", 'secret = "', "pwd: "], 7), tail(F.substr(b64, F.lit(1), short))),
        (0, pick(["commit ", "sha1 ", "revision ", "hash: ", "integrity="], 8), F.substr(sha[0], F.lit(1), F.lit(40))),
        (0, pick(["md5 ", "checksum: ", "etag = ", "digest "], 9), F.md5(sha[0])),
        (0, pick(["id=", "uuid: ", "guid ", " "], 10), F.concat_ws("-", F.substr(sha[0], F.lit(1), F.lit(8)), F.substr(sha[0], F.lit(9), F.lit(4)), F.substr(sha[0], F.lit(13), F.lit(4)), F.substr(sha[0], F.lit(17), F.lit(4)), F.substr(sha[0], F.lit(21), F.lit(12)))),
        (0, pick(["file ", "in .", "see https:/", " "], 11), F.concat(F.lit("/"), word[0], F.lit("/"), word[1], F.lit("2/"), word[2])),
        (0, pick(["the ", "call ", "def ", "key ", "in "], 12), F.concat_ws("_", word[0], word[1], word[2], F.pmod(F.col("id"), F.lit(97)))),
        (0, pick(["password=", "token: ", 'secret = "'], 13), F.concat_ws("_", F.lit("your"), word[0], word[1], F.lit("1"))),
        (0, pick(["tel ", "no. ", "isbn ", "order ", "", "card "], 14), F.substr(number, F.lit(1), short)),
        (0, pick(["", "on ", "the "], 15), F.concat_ws("-", F.lit("2024"), F.lpad(F.pmod(F.col("id"), F.lit(12)), 2, "0"), F.lit("11"), F.pmod(F.col("id"), F.lit(9)), word[0])),
        (0, pick(["", "the ", "and "], 16), F.concat(word[0], word[1], word[2], F.pmod(F.col("id"), F.lit(10)))),
        (0, pick(["", "to ", "from "], 17), F.concat(word[0], F.lit("-"), word[1], F.pmod(F.col("id"), F.lit(10)))),
        (0, pick(["password=", "token=", "key: "], 18), F.concat(F.repeat(F.lit("x"), 12), F.pmod(F.col("id"), F.lit(10)))),
        (1, pick(chosen, 42), F.concat(own_word[0], F.pmod(F.col("id"), F.lit(10)), F.when(F.col("id") % 4 < 2, F.substr(own_word[1], F.lit(1), F.lit(4))).otherwise(pick(["pass", "word", "page", "user", "home"], 65)))),
        (1, pick(chosen, 43), F.concat_ws("-", *own_word)),
        (1, pick(chosen, 44), F.concat(F.initcap(F.translate(own_word[0], "aoe", "@03")), mark(45), F.initcap(F.when(F.col("id") % 4 < 2, own_word[1]).otherwise(word[3])), mark(46), F.substr(year, F.lit(1), (F.pmod(F.xxhash64(F.lit(66), "id"), F.lit(4)) + 1).cast("int")))),
        (1, pick(chosen, 47), F.concat(F.translate(F.initcap(own_word[0]), "oae", "04@"), F.substr(sha[1], F.lit(1), F.lit(3)), mark(48), year)),
        (1, pick(chosen + ["token=", "api_key: ", "client_secret="], 49), letters),
        (1, pick(["API_KEY_2024X=", "AWS_S3_SECRET_KEY=", "TOKEN_V2_PROD1=", "secret_key_2 = '", "S3_ACCESS_KEY_01: "], 50), tail(F.substr(b64, F.lit(1), short))),
        (0, pick(["HOST=", "note: ", "name: ", "level=", 'title = "', "as follows: ", "type="], 51), F.concat(pick(CHOSEN, 52), F.substr(word[0], F.lit(1), F.lit(5)))),
        (0, pick(["file=", "host: ", 'name = "', "result: ", "at="], 53), F.concat(own_word[0], F.lit("."), word[0], F.when(F.col("id") % 2 == 0, F.lit("_2")).otherwise(F.lit("")))),
        (0, pick(["key ", "token ", "secret ", "the password is ", "password ", "auth "], 54), F.concat(pick(["re", "un", "over", "inter"], 55), pick(CHOSEN + DICTIONARY, 56))),
        (0, pick(chosen, 57), pick(["${DB_PASSWORD}", "<password>", "********", "<your-password>", "your_password", "{{secret}}", "$PASSWORD", "<secret-value>", "xxxxxxxx", "%(password)s"], 58)),
        (0, pick(["key=", "token = ", "password = ", "secret: ", "auth="], 59), F.concat(word[0], pick([".", "_", "->"], 60), word[1], pick(["", "()", "[0]"], 61))),
        (1, pick(chosen, 67), F.concat(own_word[0], own_word[1], F.when(F.col("id") % 2 == 0, own_word[2]).otherwise(word[4]))),
        (1, F.concat(pick(["postgres", "https", "amqp", "redis", "mysql"], 68), F.lit("://"), pick(["app", "deploy", "svc", "root", "reader"], 69), F.lit(":")), F.when(F.col("id") % 4 < 2, F.concat(own_word[0], year)).otherwise(F.substr(b64, F.lit(1), short))),
        (1, F.lit("\n"), F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), b64, F.lit("\n"), sha[2], F.lit("\n-----END PRIVATE KEY-----"))),
        (1, pick(["", "token=", " with "], 70), F.concat(pick(["glpat-", "hf_", "npm_", "sk-"], 71), tail(F.substr(F.regexp_replace(F.concat(b64, b64), "[^A-Za-z0-9]", ""), F.lit(1), F.lit(36))))),
        (0, pick(["see https://", "at http://", "clone ssh://", "open https://"], 72), F.concat(word[0], F.lit("."), word[1], F.lit(":8080/"), word[2], F.lit("/"), F.substr(sha[3], F.lit(1), F.lit(12)))),
        (0, pick(["", "export ", "set "], 62), F.concat(pick(["API_KEY_", "SECRET_KEY_", "ACCESS_TOKEN_", "AWS_S3_SECRET_KEY_", "DB_PASSWORD_"], 63), year, pick(["X", "_PROD", "A", ""], 64))),
    ]
    rows = F.array(*[F.struct(F.lit(label).alias("secret"), F.concat(prose, lead).alias("before"), F.coalesce(c, F.lit("")).alias("candidate")) for label, lead, c in kinds])
    own = spark.range(first, n).select("id", F.get(rows, F.pmod(F.col("id"), F.lit(len(kinds))).cast("int")).alias("f"))
    after = F.when(F.col("f.before").rlike("\"$"), F.lit('" and ')).when(F.col("f.before").rlike("'$"), F.lit("';\n")).when(F.col("f.candidate").rlike("^[A-Z0-9]+_[A-Z0-9_]+$"), F.lit("=")).when(F.col("f.before").rlike("://[a-z]+:$"), F.lit("@db.internal:5432/x ")).otherwise(pick([" then ", ".\n", ", or ", " "], 19))
    return own.select(F.col("f.candidate").alias("candidate"), F.col("f.before").alias("before"), after.alias("after"), F.col("f.secret").cast("double").alias("secret"))


def _grown(node) -> tuple | float:
    """A tree as nested (feature, threshold, left, right), with the share of secrets at each leaf."""
    if node.subtreeDepth() == 0:
        counts = node.impurityStats().stats()
        return float(counts[1] / (counts[0] + counts[1]))
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _grown(node.leftChild()), _grown(node.rightChild())


def fitted(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 5):
    """Spark's random forest on labelled findings, and the rows it was fitted on."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    own = findings.select("secret", *[v.cast("double").alias(k) for k, v in features(F.col("candidate"), F.col("before"), F.col("after")).items()])
    own = materialise(own.coalesce(1), "secret-findings")  # in one part, so that every cluster draws the same trees
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(own)
    return RandomForestClassifier(labelCol="secret", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="5").fit(vectors.select("secret", "features")), vectors


def forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list:
    """A random forest trained on labelled findings, as nested tuples."""
    return nested(fitted(findings, trees, depth, seed)[0])


def nested(model) -> list:
    return [_grown(tree.rootNode()) for tree in model._java_obj.trees()]


def vote(trees: list, of: dict[str, Column]) -> Column:
    """The mean of the trees' leaves, as nested conditions."""

    def at(node: tuple | float) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, threshold, left, right = node
        return F.when(of[name] <= F.lit(threshold), at(left)).otherwise(at(right))

    return sum((at(t) for t in trees), F.lit(0.0)) / len(trees)


@lru_cache(maxsize=4)
def _trained(spark: SparkSession, application: str) -> tuple:
    return tuple(forest(labelled_findings(spark)))


def trained(spark: SparkSession) -> list:
    """The forest for this application; it is trained once."""
    return list(_trained(spark, spark.sparkContext.applicationId))


def redacted(docs: DataFrame, trees: list | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced, and the columns n_candidates (long) and secrets (start, end, score).

    One row per input row; null texts stay null and have no candidates. Positions count code points of the old text.
    Input columns named like the two new ones are replaced. Nothing is dealt out: each row is judged where it is.
    """
    trees = trees if trees is not None else trained(docs.sparkSession)
    text = F.col("text")

    def score(inputs: Column) -> Column:
        return vote(trees, {k: inputs[k] for k in FEATURES})

    def judged(c: Column, i: Column, parts: Column, ends: Column) -> Column:
        # The text before, earlier candidates included; so many pieces of a candidate and the text before it hold BEFORE characters.
        earlier = F.transform(F.filter(F.sequence(i - (BEFORE // 6 + 1), i), lambda j: (j >= 0) & (j < i)), lambda j: F.concat(F.get(ends["p"], j), F.get(ends["c"], j)))
        before = F.right(F.concat(F.array_join(earlier, ""), F.get(ends["p"], i)), F.lit(BEFORE))
        made = features(c, before, F.left(F.get(parts, i + 1), F.lit(AFTER)))
        # The one-element array binds the features to a name, so that the trees read them and don't make them anew.
        return F.get(F.transform(F.array(F.struct(*[v.cast("double").alias(k) for k, v in made.items()])), score), F.lit(0))

    def ended(x: Column) -> Column:
        ends = [F.transform(x[k], lambda v: F.right(v, F.lit(BEFORE))).alias(k) for k in "cp"]
        return F.struct(x["c"].alias("c"), x["p"].alias("p"), F.struct(*ends).alias("ends"))

    def scanned(x: Column) -> Column:
        scores = F.transform(x["c"], lambda c, i: judged(c, i, x["p"], x["ends"]))
        return F.struct(x["c"].alias("c"), x["p"].alias("p"), scores.alias("s"))

    def measured(x: Column) -> Column:
        """Adds where each candidate starts: sums of lengths within chunks of CHUNK, on top of sums of whole chunks."""
        n = F.size(x["c"])
        lengths = F.transform(x["c"], lambda c, i: (F.char_length(c) + F.char_length(F.get(x["p"], i))).cast("bigint"))
        chunks = F.transform(F.sequence(F.lit(0), F.floor(n / CHUNK).cast("int")), lambda k: total(F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK))))
        return F.struct(x["c"].alias("c"), x["p"].alias("p"), x["s"].alias("s"), lengths.alias("w"), chunks.alias("k"))

    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, w: a + w)

    def summed(x: Column) -> Column:
        before = F.transform(x["k"], lambda _, k: total(F.slice(x["k"], F.lit(1), k)))
        return F.struct(*[x[f].alias(f) for f in "cpsw"], before.alias("k"))

    def placed(x: Column) -> Column:
        def span(c: Column, i: Column) -> Column:
            chunk = F.floor(i / CHUNK).cast("int")
            end = F.get(x["k"], chunk) + total(F.slice(x["w"], chunk * CHUNK + 1, i - chunk * CHUNK + 1))
            return F.struct((end - F.char_length(c)).alias("start"), end.alias("end"), F.get(x["s"], i).alias("score"))

        found = F.filter(F.transform(x["c"], span), lambda f: f["score"] > VERDICT)
        kept = F.transform(x["p"], lambda p, i: F.concat(p, F.coalesce(F.when(F.get(x["s"], i) > VERDICT, F.lit(REPLACEMENT)).otherwise(F.get(x["c"], i)), F.lit(""))))
        return F.struct(F.size(x["c"]).cast("bigint").alias("n"), found.alias("found"), F.array_join(kept, "").alias("text"))

    def parted(x: Column) -> Column:
        """Leads go to the text before."""
        leads = F.transform(x["m"], lambda m: F.char_length(F.regexp_extract(m, LEAD, 0)))
        return F.struct(x["m"].alias("m"), x["p"].alias("p"), leads.alias("l"))

    def cut(x: Column) -> Column:
        c = F.transform(x["m"], lambda m, i: F.substr(m, F.get(x["l"], i) + 1))
        p = F.transform(x["p"], lambda p, i: F.concat(p, F.coalesce(F.left(F.get(x["m"], i), F.get(x["l"], i)), F.lit(""))))
        return F.struct(c.alias("c"), p.alias("p"))

    result = F.array(F.struct(F.col("__met").alias("m"), F.split(text, CANDIDATE, -1).alias("p")))
    for step in (parted, cut, ended, scanned, measured, summed, placed):
        result = F.transform(result, step)
    result = F.get(result, F.lit(0))
    own = docs.withColumn("__met", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    own = own.withColumn("__scan", F.when(F.size("__met") > 0, result))
    none = F.array().cast("array<struct<start:bigint,end:bigint,score:double>>")
    keep = [F.col(f"`{c}`") if c != "text" else F.coalesce("__scan.text", "text").alias("text") for c in docs.columns if c not in ("n_candidates", "secrets")]
    return own.select(*keep, F.coalesce("__scan.n", F.lit(0)).alias("n_candidates"), F.coalesce("__scan.found", none).alias("secrets"))


def scan(docs: DataFrame, trees: list | None = None) -> DataFrame:
    """Of (doc_id, text): doc_id, n_candidates, n_secrets, secrets (start:end, comma-joined; code points), redacted_sha256.

    One row per input row, repeated rows included. Null text counts as empty; a null doc_id is kept. ``redacted_sha256``
    is of the text with every secret replaced. Whole texts are read; other columns are ignored; an empty table gives no rows.
    """
    own = redacted(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), trees)
    listed = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return own.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), listed.alias("secrets"), F.sha2("text", 256).alias("redacted_sha256"))
