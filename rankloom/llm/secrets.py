"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of 16 or more key characters with a digit among them (12
after an equals sign or colon), of 8 or more after a name like ``password=``, or
one of a published key format, or whatever stands as the value of a name like
``password=`` or in an element of such a name, marks included; a word may hold
several, between any delimiters. Private key blocks are taken from their header to
the end line of the same label, headers and all, whatever their length; without
an end line, to the last line of the key. A forest votes on its length, its
character-class transitions, its dictionary coverage, the path it stands in and
the words beside it. It is fitted once on labelled findings, a bounded table (by
default ``TRAINING`` rows made by rule from published key formats and from the
usual false alarms: digests, identifiers, card numbers, addresses, paths). The
fitted trees are then compiled into column expressions, so scanning is one pass
over the documents with DataFrame functions only and no shuffle.

Edge cases: null and empty texts have no candidates; a null source is no path;
repeated candidates are found each time; whole texts are scanned; an empty table
gives no rows. A vote of exactly one half is no secret; of equal candidates of a
text each is told. Extra columns of any name are kept by :func:`redact` and not
read by :func:`scan`.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.work import drop, table

TRAINING = 6000  # labelled findings the forest is fitted on, at most
TREES, DEPTH, SEED = 15, 6, 20
VOTES = 0.5
MASK = "[SECRET]"

# Words that secrets are announced by, and words found inside identifiers and paths.
HINTS = "password passwd pwd secret token apikey api_key key auth bearer credential credentials private access client_secret signature authorization webhook".split()
HARMLESS = "sha1 sha256 md5 digest checksum hash commit revision etag uuid guid id card order invoice phone version build image layer cache list video iban integrity asset chunk trace span".split()
DICTIONARY = (
    "about access account address after agent alpha api app application archive article back base beta blog book branch build cache card category check class click client code comment common config content "
    "copy count country data date default design detail develop device document down download edit email error event example feature feed file find first flag folder form forum from group guide help home "
    "host html http https image index info install item java key label language last layer library license link list local login main manager map media member menu message method mode model module month "
    "name network new news next note number object order page part password path person photo php place plan play plugin point policy post press price print private process product profile program "
    "project public python query question read record release remote report request resource result review root sample save schema script search section secret server service session setting share shop "
    "simple site source stage start state static status store story stream style sub support system table tag target task team template test text theme time title token tool topic track train type "
    "update upload user value version video view web week widget window word work world year"
).split()
FEATURES = (
    "length", "transitions", "distinct", "digits", "uppers", "hexes", "dictionary", "slashes", "dots", "dashes", "marks", "web", "sample_path", "hinted", "harmless", "assigned", "quoted", "all_digits", "known_start", "made_up",
    "filled_in", "media", "versioned", "account", "wordlike",
)
# Words beside a value that say it is no real one.
MADE_UP = "example|sample|dummy|placeholder|fake|changeme|redacted|fixture"
# Key-like runs of a word, whatever stands before and after them; published key formats also inside longer runs.
RUN = r"([A-Za-z0-9+/_\-.~]{7,}[A-Za-z0-9+/_\-](?:={1,2}(?![A-Za-z0-9+/_\-.~\"'=]))?)"
STARTS = r"AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|glsa_|sk-|sk_|rk_|whsec_|xox[abprs]-|eyJ|npm_|pypi-|SG\.|ya29\.|GOCSPX-|hf_|dop_v1_|shp(?:at|ca|pa|ss)_|sq0(?:atp|csp)-|hvs\.|lin_api_|PMAK-|NRAK-|key-"
PUBLISHED = (
    r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[A-Za-z0-9_\-]{35}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|glsa_[A-Za-z0-9_]{32,}"
    r"|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|whsec_[A-Za-z0-9]{24,}|sk-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]*)?|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_\-]{16,}"
    r"|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|ya29\.[A-Za-z0-9_\-]{20,}|GOCSPX-[A-Za-z0-9_\-]{20,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{64}|shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}|sq0(?:atp|csp)-[A-Za-z0-9_\-]{20,}"
    r"|hvs\.[A-Za-z0-9_\-]{24,}|lin_api_[A-Za-z0-9]{32,}|PMAK-[0-9a-f\-]{24,}|NRAK-[A-Z0-9]{27}|dapi[0-9a-f]{32}(?![A-Za-z0-9])|SK[0-9a-f]{32}(?![A-Za-z0-9])|key-[0-9a-z]{32}(?![A-Za-z0-9])|T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[A-Za-z0-9]{24}|[0-9]{8,10}:AA[A-Za-z0-9_\-]{33})"
)
# Private key blocks. Possessive loops go through texts of any length without recursion.
BREAK = r"(?:\\[nr]|\s)*+"
HEADER = r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----"
TO_ITS_END = r"[^\-]*+(?:-(?!----(?:BEGIN|END) )[^\-]*+)*+-----END \2-----"
KEY_LINES = rf"(?:{BREAK}(?:(?:Proc-Type|DEK-Info): ?[^\s\\]*+|(?:Version|Comment|Hash|Charset|MessageID): [^\r\n\\]*+))*+(?:{BREAK}[A-Za-z0-9+/=]{{16,}}+)*+(?:{BREAK}[A-Za-z0-9+/]{{1,15}}={{1,2}})?"
BLOCK = "-----BEGIN-----"
KEY_BLOCK = rf"({HEADER}(?:{TO_ITS_END}|{KEY_LINES}))"
ASSIGNED = r"[=:>][\"']?$"
NAMED = rf"(?i)(?:{'|'.join(HINTS)})[A-Za-z0-9_\-]*[\"']?(?:[=:]+[\"']?|>)$"
# Values of names that leave no doubt, with all their marks.
NAMED_VALUE = r"(?i)(?:password|passwd|passphrase|pwd|secret|token|api_?key|credential)[A-Za-z0-9_\-]*[\"']?(?:[=:]+[\"']?|>)([^\s\"'<>&,;=:][^\s\"'<>&,;]{7,})"
NAME_BEFORE = r"(?:password|passwd|passphrase|pwd|secret|token|api_?key|credential)[a-z0-9_\-]*[\"']?[=:]+$"
NEXT_VALUE = r"^[\"']?([^\s\"'<>,;]{8,})"


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def lead_of(word: Column, value: Column) -> Column:
    """What stands before the value in its word."""
    return F.split_part(word, value, F.lit(1))


def candidates(text: Column, source: Column) -> Column:
    """Array of (position, word, value, before, after, source), position counted in words from 0 (a private key block is part of one word); a word may hold several."""

    def pick(words: Column) -> Column:
        near = lambda i: F.lower(F.coalesce(F.get(words, i), F.lit("")))
        opened = lambda i: F.rlike(near(i - 1), F.lit("[=:]$"))
        worth = lambda w, i: (F.length(w) >= 8) & (F.rlike(w, F.lit(f"[0-9=:>]|{STARTS}")) | opened(i))

        def runs(i: Column) -> Column:
            word = F.get(words, i)
            before = F.concat_ws(" ", near(i - 2), near(i - 1))

            def looks(v: Column) -> Column:
                lead = lead_of(word, v)
                digit, n = F.rlike(v, F.lit("[0-9]")), F.length(v)
                shaped = digit & (F.rlike(v, F.lit(r"[A-Za-z0-9+/_\-]{16,}")) | ((n >= 12) & F.rlike(lead, F.lit(ASSIGNED))))
                # announced by name, or the password of a url: any characters, from 8 on
                named = F.rlike(lead, F.lit(NAMED)) | (F.rlike(lead, F.lit("://[^/@]*:$")) & F.startswith(F.substr(word, F.length(lead) + n + 1), F.lit("@")))
                said = opened(i) & F.rlike(before, F.lit(rf"(^|[^a-z])({'|'.join(HINTS)})([^a-z]|$)")) & F.rlike(lead, F.lit("^[\"']?$"))
                return shaped | named | said | F.rlike(v, F.lit(f"^{PUBLISHED}$"))

            runs_ = F.filter(F.regexp_extract_all(word, F.lit(RUN), F.lit(1)), looks)
            named_ = F.array_union(F.regexp_extract_all(word, F.lit(NAMED_VALUE), F.lit(1)), F.when(F.rlike(near(i - 1), F.lit(NAME_BEFORE)), F.regexp_extract_all(word, F.lit(NEXT_VALUE), F.lit(1))).otherwise(F.array().cast("array<string>")))
            found = F.array_union(F.array_union(F.regexp_extract_all(word, F.lit(PUBLISHED), F.lit(1)), named_), runs_)
            return F.transform(
                found,
                lambda v: F.struct(
                    i.alias("position"),
                    word.alias("word"),
                    v.alias("value"),
                    before.alias("before"),
                    near(i + 1).alias("after"),
                    F.lower(F.coalesce(source.cast("string"), F.lit(""))).alias("source"),
                ),
            )

        at = F.filter(F.transform(words, lambda w, i: F.when(worth(w, i), i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(at, runs))

    return F.transform(F.array(split_words(text)), pick)[0]


def without_blocks(text: Column) -> Column:
    """The text with BLOCK in place of each private key block."""
    return F.when(F.contains(text, F.lit("-----BEGIN ")), F.regexp_replace(text, F.lit(KEY_BLOCK), F.lit(BLOCK))).otherwise(text)


def key_blocks(text: Column, rest: Column) -> Column:
    """Array of (position, word, value, score): whole private key blocks; the header says it all. ``rest`` is the text without them."""
    found = F.when(F.contains(text, F.lit("-----BEGIN ")), F.regexp_extract_all(text, F.lit(KEY_BLOCK), F.lit(1))).otherwise(F.array().cast("array<string>"))

    def told(v: Column, i: Column) -> Column:
        before = F.call_function("substring_index", rest, F.lit(BLOCK), i + 1)
        return F.struct((F.size(split_words(F.concat(before, F.lit("-")))) - 1).alias("position"), F.lit("-----BEGIN").alias("word"), v.alias("value"), F.lit(1.0).alias("score"))

    return F.transform(found, told)


def features(c: Column) -> dict[str, Column]:
    """Numbers that the forest sees of one candidate (a struct as made by :func:`candidates`)."""
    value, word = c["value"], c["word"]
    n = F.length(value).cast("double")
    share = lambda pattern: (n - F.length(F.regexp_replace(value, pattern, ""))) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    listed = lambda words: "(" + "|".join(words) + ")"
    flag = lambda x: x.cast("double")
    lead = lead_of(word, value)
    rest = F.substr(word, F.length(lead) + F.length(value) + 1)
    name = F.lower(F.regexp_extract(lead, r"([A-Za-z0-9_\-]+)[\"']?(?:[=:]+[\"']?|>)$", 1))
    around = F.concat_ws(" ", c["before"], name)
    return {
        "length": n,
        "transitions": (runs - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "digits": share("[0-9]+"),
        "uppers": share("[A-Z]+"),
        "hexes": share("[0-9a-f]+"),
        "dictionary": (n - F.length(F.regexp_replace(F.lower(value), listed(sorted(DICTIONARY, key=len, reverse=True)), ""))) / n,
        "slashes": n - F.length(F.replace(value, F.lit("/"), F.lit(""))),
        "dots": n - F.length(F.replace(value, F.lit("."), F.lit(""))),
        "dashes": n - F.length(F.regexp_replace(value, "[-_]", "")),
        "marks": n - F.length(F.regexp_replace(value, r"[^A-Za-z0-9+/_\-.~=]", "")),
        "web": flag(F.rlike(value, F.lit("^//|^www")) | F.endswith(lead, F.lit("@")) | (F.startswith(rest, F.lit("@")) & ~F.endswith(lead, F.lit(":")))),
        "sample_path": flag(F.rlike(c["source"], F.lit("test|example|sample|fixture|docs?/|readme|lock"))),
        "hinted": flag(F.rlike(around, F.lit(rf"(^|[^a-z]){listed(HINTS)}([^a-z]|$)")) | F.rlike(name, F.lit(f"{listed(HINTS)}$"))),
        "harmless": flag(F.rlike(around, F.lit(rf"(^|[^a-z]){listed(HARMLESS)}([^a-z0-9]|$)"))),
        "assigned": flag(F.rlike(lead, F.lit(ASSIGNED)) | (F.rlike(lead, F.lit("^[\"']?$")) & F.rlike(c["before"], F.lit(r"[=:]$")))),
        "quoted": flag(F.rlike(lead, F.lit("[\"']$"))),
        "all_digits": flag(F.rlike(value, F.lit(r"^[0-9\-]+$"))),
        "known_start": flag(F.rlike(value, F.lit(f"^({STARTS})")) | F.rlike(value, F.lit(f"^{PUBLISHED}$"))),
        "made_up": flag(F.rlike(F.concat_ws(" ", c["before"], c["after"]), F.lit(MADE_UP))),
        "filled_in": flag(F.rlike(value, F.lit(r"\$[{(A-Z]|\{\{|%[({]|[()\[\]]|\*{3}|[xX]{4}")) | F.rlike(lead, F.lit(r"[{(\[]$"))),
        "media": flag(F.endswith(lead, F.lit("base64,")) | F.rlike(value, F.lit("^(iVBOR|/9j/|R0lGOD|PHN2Zy|data/)"))),
        "versioned": flag(F.rlike(value, F.lit(r"(^|[^0-9])[0-9]{1,3}\.[0-9]{1,3}(\.|[^0-9]|$)|\.[a-z]{2,4}$"))),
        "account": flag(F.rlike(value, F.lit("^[A-Z]{2}[0-9]{2}[A-Z0-9]{0,4}[0-9]{7,}[A-Z0-9]{0,3}$"))),
        "wordlike": share("[A-Z]?[a-z]*[aeiou][a-z]+(?![a-z0-9])"),
    }


def made_findings(spark: SparkSession, n: int = TRAINING, keep: Callable[[int], bool] = lambda k: True) -> DataFrame:
    """Labelled findings by rule: the columns of a candidate and ``secret``, half of them true.

    ``keep`` chooses among the formats of either kind by their number, to hold out whole formats.
    Both kinds stand in sources and before words of all sorts; more of the harmless
    ones stand in tests and examples or beside a word that says they are made up.
    """

    def drawn(alphabet: str, size: int, salt: int) -> Column:
        """``size`` characters of the alphabet, fixed by id and salt."""
        parts = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.substr(F.lit(alphabet), (F.pmod(F.xxhash64(F.col("id"), F.lit(salt), i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1)))
        return F.array_join(parts, "")

    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexes, mixed = dig + "abcdef", low + up + dig
    vocabulary = F.array(*map(F.lit, DICTIONARY))
    word = lambda salt: F.get(vocabulary, F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(len(DICTIONARY))).cast("int"))
    glue = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    plain = glue(drawn(low, 3, 71), " ", drawn(low, 6, 72))
    secret = [
        (glue("AKIA", drawn(up + "234567" + dig, 16, 1)), plain),
        (glue("AKIA", drawn(up + dig, 16, 2)), glue(word(3), " key")),
        (glue("ghp_", drawn(mixed, 36, 4)), plain),
        (glue("xoxb-", drawn(dig, 12, 5), "-", drawn(mixed, 24, 6)), plain),
        (glue("sk_live_", drawn(mixed, 24, 7)), plain),
        (glue("AIza", drawn(mixed + "_-", 35, 8)), plain),
        (glue("password=", drawn(hexes, 18, 9)), plain),
        (glue("password:", drawn(mixed, 14, 10)), plain),
        (glue("api_key=", drawn(mixed, 32, 11)), plain),
        (glue('"', drawn(hexes, 40, 12), '"'), F.lit("token =")),
        (glue('"', drawn(mixed, 32, 13), '"'), F.lit("secret =")),
        (glue("secret=", drawn(hexes, 32, 14)), plain),
    ]
    uuid = glue(drawn(hexes, 8, 51), "-", drawn(hexes, 4, 52), "-4", drawn(hexes, 3, 53), "-", drawn(hexes, 4, 54), "-", drawn(hexes, 12, 55))
    site = glue("https://", word(56), ".example.com/?")
    secret += [
        (glue('{"api_key":"', drawn(hexes, 32, 57), '"}'), plain),
        (glue('{"', word(58), '":1,"password":"', drawn(mixed, 16, 59), '"}'), plain),
        (glue("<code>AKIA", drawn(up + dig, 16, 60), "</code>"), plain),
        (glue(site, "token=", drawn(hexes, 32, 61), "&v=2"), plain),
        (glue("postgres://", drawn(low, 4, 62), ":", drawn(mixed, 14, 63), "@db:5432/x"), plain),
        (glue("password=", drawn(mixed, 9, 64)), plain),
        (glue("SK", drawn(hexes, 32, 101)), plain),
        (glue("key-", drawn(low + dig, 32, 102)), plain),
        (glue("password=", drawn(mixed + "!#$%*?@^~", 14, 103)), plain),
        (glue("<password>", drawn(mixed, 14, 104), "</password>"), plain),
        (glue("<secret>", drawn(mixed + "!#$%*?@^~", 16, 105), "</secret>"), plain),
        (glue("github_pat_", drawn(mixed, 22, 106), "_", drawn(mixed, 59, 107)), plain),
        (drawn(mixed + "/+", 40, 108), F.lit("secret_access_key =")),
        (drawn(mixed, 40, 109), F.lit("authorization: bearer")),
        (glue('"', drawn(mixed + "!#$%*?@^~", 14, 114), '"'), F.lit('"password":')),
        (glue("AccountKey=", drawn(mixed + "+/", 62, 115), "=="), plain),
        (glue(drawn(mixed, 26, 110), "=="), F.lit("authorization: basic")),
        (glue("SERVICE_API_KEY=", uuid), plain),
        (glue("https://hooks.example.com/services/T", drawn(up + dig, 8, 111), "/B", drawn(up + dig, 8, 112), "/", drawn(mixed, 24, 113)), plain),
        (glue("secret_key=", drawn(low + up, 32, 65)), plain),
    ]
    harmless = [
        (glue('{"id":"', uuid, '"}'), plain),
        (glue('{"sha256":"', drawn(hexes, 64, 66), '"}'), plain),
        (glue("<td>", word(67), "-", word(68), "-", drawn(dig, 6, 69), "</td>"), plain),
        (glue(site, "id=", drawn(hexes, 32, 70), "&v=2"), plain),
        (glue(site, "page=", word(73), "-", word(74), "-", drawn(dig, 4, 75), "&v=2"), plain),
        (glue("https://", word(76), ".example.com/", word(77), "/", drawn(dig, 12, 78), "?v=2"), plain),
        (glue("password:", word(79), "-", word(80), "-", word(81)), plain),
        (glue(drawn(up, 2, 121), drawn(dig, 20, 122)), plain),
        (glue(word(123), "-packages/", word(124), "-", drawn(dig, 1, 125), ".", drawn(dig, 2, 126), ".", drawn(dig, 1, 127), ".dist-info/", drawn(up, 8, 128)), plain),
        (glue("data:image/png;base64,iVBORw0KGgo", drawn(mixed + "+/", 60, 129)), plain),
        (glue(site, "list=PL", drawn(mixed + "-_", 32, 130), "&v=2"), plain),
        (drawn(hexes, 32, 131), F.lit("cache key")),
        (glue("sha512-", drawn(mixed + "+/", 86, 132), "=="), plain),
        (glue("password=${", drawn(up, 4, 133), "_", drawn(up, 8, 134), "}"), plain),
        (glue("token={{", word(135), "_", word(136), "}}"), plain),
        (glue("password=os.getenv(", drawn(up, 9, 137), ")"), plain),
        (glue("key:", word(138), "_", word(139), "_", word(140)), plain),
        (glue(drawn(dig, 1, 145), drawn(up + dig, 16, 146)), plain),
        (glue(drawn(up, 4, 147), "-", drawn(dig, 5, 148), "-", drawn(up, 6, 149), "-", drawn(dig, 3, 150)), plain),
        (glue("h1:", drawn(mixed + "+/", 43, 151), "="), plain),
        (glue("ref:", drawn(low + dig, 17, 152)), F.lit("launched as")),
        (glue(word(141), "_", word(142), "_v", drawn(dig, 1, 143), ".", drawn(dig, 2, 144), ".tar.gz"), plain),
        (drawn(dig, 16, 21), plain),
        (glue("4", drawn(dig, 15, 22)), F.lit("the card")),
        (glue(drawn(hexes, 8, 23), "-", drawn(hexes, 4, 24), "-4", drawn(hexes, 3, 25), "-", drawn(hexes, 4, 26), "-", drawn(hexes, 12, 27)), F.lit("with id")),
        (drawn(hexes, 40, 28), F.lit("at commit")),
        (drawn(hexes, 64, 29), F.lit("the sha256")),
        (glue("sha256:", drawn(hexes, 64, 30)), F.lit("image layer")),
        (glue("https://", word(31), ".example.com/", word(32), "/", word(33), "-", drawn(dig, 5, 34)), plain),
        (glue("/usr/", word(35), "/", word(36), "_", word(37), drawn(dig, 2, 38)), plain),
        (glue(word(39), "-", word(40), "-", word(41), "-", drawn(dig, 4, 42)), plain),
        (glue(drawn(low, 7, 43), ".", drawn(dig, 2, 44), "@mail", drawn(dig, 1, 45), ".example.com"), plain),
        (glue("2", drawn(dig, 3, 46), "-01-12T10:", drawn(dig, 2, 47), ":00Z"), plain),
        (glue(drawn(low, 11, 48), drawn(low, 9, 49), drawn(dig, 1, 50)), plain),
    ]
    secret, harmless = ([f for k, f in enumerate(kind) if keep(k)] for kind in (secret, harmless))
    base = spark.range(0, n, 1, 4)
    choose = lambda rows, k: F.get(F.array(*[r[k] for r in rows]), F.pmod(F.floor(F.col("id") / 2), F.lit(len(rows))).cast("int"))
    is_secret = F.col("id") % 2 == 0
    made = base.select("id", is_secret.alias("secret"), F.when(is_secret, choose(secret, 0)).otherwise(choose(harmless, 0)).alias("word"), F.when(is_secret, choose(secret, 1)).otherwise(choose(harmless, 1)).alias("before"))
    # the value that a scan of the word would take
    runs = F.regexp_extract_all("word", F.lit(RUN), F.lit(1))
    first = lambda pattern: F.get(F.regexp_extract_all("word", F.lit(pattern), F.lit(1)), F.lit(0))
    following = F.when(F.rlike("before", F.lit(NAME_BEFORE)), first(NEXT_VALUE))
    told = F.coalesce(first(PUBLISHED), first(NAMED_VALUE), following, F.get(F.filter(runs, lambda v: F.rlike(v, F.lit("[0-9]")) & (F.length(v) >= 12)), F.lit(0)), F.element_at(runs, F.lit(-1)))
    draw = lambda salt, most: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(most))
    sampled = lambda salt: draw(salt, 100) < F.when(F.col("secret"), 2).otherwise(25)
    after = F.when(sampled(91), F.get(F.array(*map(F.lit, MADE_UP.split("|"))), draw(92, MADE_UP.count("|") + 1).cast("int"))).otherwise(word(93))
    source = F.when(sampled(94), F.get(F.array(*map(F.lit, ("tests/test_app.py", "docs/setup.md", "examples/run.sh", "package-lock.json"))), draw(95, 4).cast("int"))).otherwise(F.concat(F.lit("src"), draw(96, 30)))
    return made.select("secret", "word", told.alias("value"), "before", after.alias("after"), source.alias("source")).where("value <> ''")


def train(labelled: DataFrame):
    """A random forest of at most TRAINING labelled findings.

    Their features are worked out once and stored: the fit passes over them a
    dozen times. Rows stay in the partitions and the order they came in, which the
    forest's draws depend on.
    """
    f = features(F.struct(*labelled.columns))
    rows = labelled.limit(TRAINING).select(F.col("secret").cast("double").alias("label"), *(f[x].cast("double").alias(x) for x in FEATURES))
    stored = table(rows.withColumn("_at", F.monotonically_increasing_id()), "findings")
    part = F.shiftright("_at", 33).cast("int")
    parts = (stored.agg(F.max(part)).first()[0] or 0) + 1
    dealt = stored.repartitionById(parts, part).sortWithinPartitions("_at").drop("_at")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(dealt)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=3, featureSubsetStrategy="0.5", seed=SEED).fit(ready)
    drop(stored)
    return model


def compiled(model) -> list[list]:
    """The forest's trees, each a nested [feature, threshold, left, right] or a vote 0 or 1."""
    return [parse_tree(text) for text in re.split(r"\n\s*Tree \d+[^\n]*:\n", model.toDebugString)[1:]]


def fit(labelled: DataFrame) -> list[list]:
    return compiled(train(labelled))


def parse_tree(text: str):
    lines = [x.strip() for x in text.strip().split("\n")]
    at = 0

    def node():
        nonlocal at
        line, at = lines[at], at + 1
        if line.startswith("Predict:"):
            return float(line.split()[1])
        m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        left = node()
        at += 1  # Else
        return [int(m[1]), float(m[2]), left, node()]

    return node()


def votes(trees: list, of: Column) -> Column:
    """The share of trees that vote for a secret, on a struct of the features."""

    def expr(t) -> Column:
        if not isinstance(t, list):
            return F.lit(t)
        left, right = expr(t[2]), expr(t[3])
        return left if t[2] == t[3] else F.when(of[FEATURES[t[0]]] <= F.lit(t[1]), left).otherwise(right)

    total = F.lit(0.0)
    for t in trees:
        total = total + expr(t)
    return total / len(trees)


def judged(text: Column, source: Column, trees: list) -> Column:
    """Candidates with their ``score``."""

    def scored(c: Column) -> Column:
        f = features(c)
        kept = F.transform(F.array(F.struct(*(f[x].cast("double").alias(x) for x in FEATURES))), lambda x: votes(trees, x))[0]
        return F.struct(c["position"].alias("position"), c["word"].alias("word"), c["value"].alias("value"), kept.alias("score"))

    rest = without_blocks(text)
    return F.concat(F.transform(candidates(rest, source), scored), key_blocks(text, rest))


def scan(df: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, position, value_sha256, n_chars, score, is_secret for each candidate of each document."""
    trees = fit(labelled if labelled is not None else made_findings(df.sparkSession))
    found = df.select("doc_id", F.explode(judged(F.coalesce("text", F.lit("")), F.col("source"), trees)).alias("c"))
    return found.select("doc_id", F.col("c.position").cast("long").alias("position"), F.sha2("c.value", 256).alias("value_sha256"), F.length("c.value").cast("long").alias("n_chars"), "c.score", (F.col("c.score") > VOTES).alias("is_secret"))


def redact(df: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The same rows and columns; every secret's value in ``text`` is replaced by MASK."""
    trees = fit(labelled if labelled is not None else made_findings(df.sparkSession))
    secret = F.array_distinct(F.transform(F.filter(judged(F.col("text"), F.col("source"), trees), lambda c: c["score"] > VOTES), lambda c: c["value"]))
    # longer ones first: a value may hold another
    ordered = F.transform(F.sort_array(F.transform(secret, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda x: x["v"])
    masked = F.aggregate(ordered, F.col("text"), lambda t, v: F.replace(t, v, F.lit(MASK)))
    return df.withColumn("text", F.when(F.col("text").isNotNull(), masked))
