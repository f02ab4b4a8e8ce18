"""Secret scans in DataFrame functions alone: patterns, and character Markov models of random strings and identifiers."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.llm._common import table

# Fixed patterns of the base scan, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A whole run of these characters is a candidate of the Markov models; so are the stretches of an ordinary one, widened to its parts.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
KINDS = ("assign", "access", "hex", "markov")
MARK = "[SECRET]"

# Ordinary words from which the built-in samples of identifiers, paths and compound words are put together.
WORDS = (
    "account action address after and array async base before between buffer build button byte cache call cancel change channel char check class clean client close code column command config connect content context "
    "control convert copy count create current data date default delete detail device direct display document domain download element enable encode engine entry error event example export field file filter find first "
    "format function general handler header height history home image import index information input insert instance integer internal item key label language last layout length level library list load local location "
    "login manager message method model module name network node notification number object offset open operation option order output page panel parameter parent parse password path payment pending position process "
    "profile project property public query random reader record register release remove report request resource response result return route sample schedule schema search section security select server service session "
    "setting shared source start state status storage stream string style system table target template test text thread the this time token total transaction transfer translation type unit update upload user validate "
    "value version video view visible when where width window with worker writer yield "
    "ation chaque comme dans elle encore entre être leur mais même nous pour quand sans sont tout une vous aber auch dass durch eine haben heit keit lich nicht nach noch oder schaft sich über ung werden wird zwischen "
    "ción como cuando desde donde ellos entonces esta hasta mente mismo muy para pero porque siempre sobre también todo"
)
# Common letter pairs of written languages, of which compound words of any language are put together.
SYLLABLES = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ei ie ge un au la do el os ue qu ai eu"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _before(units: Column) -> Column:
    """units' prefix sums, without the element itself; in blocks, so that the cost is near linear."""
    size = 128
    part = lambda u, b, n: F.aggregate(F.slice(u, b * size + 1, n), F.lit(0), lambda s, x: s + x)

    def of(u: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.expr("int(0)") + F.floor((F.size(u) - 1) / size).cast("int")), lambda b: part(u, b, F.lit(size)))
        sums = let(blocks, lambda v: F.aggregate(v, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))))
        return let(sums, lambda s: F.transform(u, lambda _, i: let(F.floor(i / size).cast("int"), lambda b: F.get(s, b) + part(u, b, F.pmod(i, F.lit(size))))))

    return let(units, of)


def found(text: Column, regex: str, good: Column | None = None) -> Column:
    """(s, e) of the leftmost non-overlapping matches, in code points, e exclusive. good: booleans, by match.

    What split() leaves between the matches gives the places.
    """
    sizes = lambda a: F.transform(a, F.char_length)
    none = F.lit(None).cast("array<struct<s:int,e:int>>")

    def spans(m: Column) -> Column:
        return let(sizes(F.split(text, regex, -1)), lambda p: let(_before(F.zip_with(p, m, lambda a, b: a + F.coalesce(b, F.lit(0)))), lambda at: F.transform(m, lambda n, i: F.struct((F.get(at, i) + F.get(p, i)).alias("s"), (F.get(at, i) + F.get(p, i) + n).alias("e")))))

    every = let(sizes(F.regexp_extract_all(text, F.lit(regex), F.lit(0))), spans)
    if good is not None:
        every = let(good, lambda g: F.filter(every, lambda _, i: F.get(g, i)))
    return F.coalesce(F.when(text.rlike(regex), every), none, F.array().cast("array<struct<s:int,e:int>>"))


def labelled_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(sample, secret): built-in training strings, the same on every run. n of each label."""
    ids = spark.range(n)
    h = lambda salt: F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    size = (F.lit(18) + F.pmod(F.xxhash64("id"), F.lit(40))).cast("int")
    raw = F.base64(F.unhex(F.concat(h("a"), h("b"))))
    random = F.when(F.pmod("id", F.lit(4)) == 0, h("hex")).when(F.pmod("id", F.lit(4)) == 1, raw).when(F.pmod("id", F.lit(4)) == 2, F.regexp_replace(raw, "[+/=]", "")).otherwise(F.upper(F.regexp_replace(raw, "[+/=]", "")))
    words = F.split(F.lit(WORDS), " ")
    pick = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)).cast("int"))
    four = [pick(k) for k in range(4)]
    digits = F.translate(F.substring(h("n"), 1, 20), "abcdef", "012345")
    kind = F.pmod("id", F.lit(15))
    part = lambda text, *cuts: F.concat(*[F.substring(text, a, n) if isinstance(a, int) else F.lit(a) for a, n in cuts])
    uuid = part(h("u"), (1, 8), ("-", 0), (9, 4), ("-", 0), (13, 4), ("-", 0), (17, 4), ("-", 0), (21, 12))
    moment = F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit("t")), F.lit(2_000_000_000)))
    form = F.pmod(F.xxhash64("id", F.lit("f")), F.lit(4))
    date = F.when(form == 0, F.date_format(moment, "yyyy-MM-dd'T'HH-mm-ss-000000")).when(form == 1, F.date_format(moment, "yyyy/MM/dd/HH_mm_ss")).when(form == 2, F.date_format(moment, "yyyyMMddHHmmss000")).otherwise(F.date_format(moment, "yyyy-MM-dd-HH-mm-ss"))
    letters = F.concat(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" * 2), F.lit("abcdefghijklmnopqrstuvwxyz0123456789"))
    rule = F.when(form == 0, F.substring(letters, F.pmod(F.xxhash64("id", F.lit("a")), F.lit(80)).cast("int") + 1, size)).otherwise(F.repeat(F.substring(F.lit("-_=+/0xXaAzZ1o"), (F.pmod(F.xxhash64("id", F.lit("r")), F.lit(14)) + 1).cast("int"), F.lit(1)), size))
    dna = F.substring(F.translate(F.concat(h("d"), h("e")), "0123456789abcdef", "ACGT" * 4), F.lit(1), size)
    syllables = F.split(F.lit(SYLLABLES), " ")
    nine = [F.get(syllables, F.pmod(F.xxhash64("id", F.lit(f"s{k}")), F.size(syllables)).cast("int")) for k in range(9)]
    unknown = F.substring(F.regexp_replace(F.lower(F.concat(raw, F.base64(F.unhex(h("w"))))), "[^a-z]", ""), F.lit(1), size)  # a word of a language that the others don't cover
    compound = F.when(form < 2, F.concat(*nine)).otherwise(unknown)
    camel = F.concat(*[x for k in range(0, 9, 3) for x in (F.initcap(F.concat(*nine[k : k + 2])) if k else F.concat(*nine[:2]), nine[k + 2])])
    plain = (
        F.when(kind == 0, F.concat_ws("_", *four)).when(kind == 1, F.concat(four[0], *[F.initcap(w) for w in four[1:]])).when(kind == 2, F.concat_ws("-", *four)).when(kind == 3, F.upper(F.concat_ws("_", *four[:3])))
        .when(kind == 4, F.concat_ws("/", *four)).when(kind == 5, digits).when(kind == 6, F.concat(F.concat_ws("_", *four[:3]), F.substring(digits, 1, 3))).when(kind == 7, F.upper(F.concat(*four[:3])))
        .when(kind == 8, F.concat(*four)).when(kind == 9, rule).when(kind == 10, date).when(kind == 11, dna).when(kind == 12, uuid).when(kind == 13, camel).otherwise(compound)
    )
    return ids.select(F.substring(random, F.lit(1), size).alias("sample"), F.lit(True).alias("secret")).unionAll(ids.select(plain.alias("sample"), F.lit(False).alias("secret")))


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio (random to ordinary) of each pair of neighbours, at 128 * first + second.

    samples: (sample string, secret boolean), rows with nulls are passed over. The driver gets at most two counts a pair of
    ASCII characters, whatever the number of samples. Character 0 is the start of a string.
    """
    chars = F.filter(F.transform(F.split("sample", ""), F.ascii), lambda c: c.between(1, 127))
    pairs = let(F.concat(F.array(F.lit(0)), chars), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.get(c, i - 1) * 128 + F.get(c, i)))
    rows = samples.filter("secret is not null and length(sample) > 0").filter(F.size(chars) > 0).select("secret", F.explode(pairs).alias("pair")).groupBy("secret", "pair").count().collect()
    count = {(r["secret"], r["pair"]): r["count"] for r in rows}
    of = {s: [sum(count.get((s, a * 128 + b), 0) for b in range(128)) for a in range(128)] for s in (True, False)}
    kinds = len({p % 128 for _, p in count}) or 1
    log = lambda s, a, b: math.log((count.get((s, a * 128 + b), 0) + smooth) / (of[s][a] + smooth * kinds))
    return [round(log(True, a, b) - log(False, a, b), 5) for a in range(128) for b in range(128)]


def ratio(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of an ASCII string."""
    llr = F.from_json(F.lit(json.dumps(model)), "array<double>")
    chars = F.transform(F.split(token, ""), F.ascii)
    return let(F.concat(F.array(F.lit(0)), chars), lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda s, i: s + F.get(llr, F.get(c, i - 1) * 128 + F.get(c, i))))


def stretches(token: Column, model: list[float], threshold: float) -> Column:
    """(s, e) of the secrets in a run of CANDIDATE: the whole run if its ratio exceeds the threshold and EACH for each of its characters, else its random stretches; either with KINDS_OF_CHARACTERS.

    A stretch ends where the sum of the ratios has fallen by the threshold, so neither ordinary text beside it nor another
    stretch cancels it. It is widened to whole parts between "/", "_" and "-", joined with those that it touches, and kept if it has
    LEAST characters, as a run must have. What follows a separator is no evidence for a stretch, only against it: random samples have none.
    """
    spans = "array<struct<s:int,e:int>>"
    text = F.split(token, "")
    kinds = lambda x: F.size(F.array_distinct(F.slice(text, x["s"] + 1, x["e"] - x["s"])))
    llr = F.from_json(F.lit(json.dumps(model)), "array<double>")
    pair = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    state = lambda total, start, top, end, out: F.struct(total.alias("total"), start.cast("int").alias("start"), top.alias("top"), end.cast("int").alias("end"), out.alias("out"))
    zero = F.lit(0.0)

    def step(a: Column, i: Column, r: Column) -> Column:
        def of(total: Column) -> Column:
            done = a["top"] > threshold
            fallen = state(zero, i + 1, zero, i + 1, F.when(done, F.concat(a["out"], F.array(pair(a["start"], a["end"])))).otherwise(a["out"]))
            risen = state(total, a["start"], total, i + 1, a["out"])
            return F.when(total > a["top"], risen).when(total <= F.when(done, a["top"] - threshold).otherwise(zero), fallen).otherwise(state(total, a["start"], a["top"], a["end"], a["out"]))

        return let(a["total"] + r, of)

    def widened(found: Column, cuts: Column, size: Column) -> Column:
        begin = lambda x: F.coalesce(F.array_max(F.filter(cuts, lambda c: c <= x["s"])) + 1, F.lit(0))
        finish = lambda x: F.coalesce(F.array_min(F.filter(cuts, lambda c: c >= x["e"])), size)
        parts = F.filter(F.transform(found, lambda x: pair(F.least(begin(x), x["e"] - 1), finish(x))), lambda x: x["s"] < x["e"])
        join = lambda out, x: let(
            F.get(out, F.size(out) - 1),
            lambda last: F.when((F.size(out) > 0) & (x["s"] <= last["e"] + 1), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(pair(last["s"], F.greatest(last["e"], x["e"]))))).otherwise(F.concat(out, F.array(x))),
        )
        return F.aggregate(parts, F.array().cast(spans), join)

    def inner(c: Column) -> Column:
        of = lambda a, b: let(F.get(llr, a * 128 + b), lambda r: F.when(a.isin(*map(ord, "/_-")), F.least(r, zero)).otherwise(r))
        ratios = F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: of(F.get(c, i - 1), F.get(c, i)))
        first = state(zero, F.lit(0), zero, F.lit(0), F.array().cast(spans))
        last = lambda a: F.when(a["top"] > threshold, F.concat(a["out"], F.array(pair(a["start"], a["end"])))).otherwise(a["out"])
        found = let(ratios, lambda r: F.aggregate(F.sequence(F.lit(0), F.size(r) - 1), first, lambda a, i: step(a, i, F.get(r, i)), last))
        size = F.size(c) - 1
        cuts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.get(c, i + 1).isin(*map(ord, "/_-")))
        long = lambda x: F.least(x["e"], F.char_length(F.rtrim(token, F.lit("=")))) - x["s"] >= LEAST
        kept = lambda f: F.filter(let(cuts, lambda at: widened(f, at, size)), lambda x: long(x) & (kinds(x) >= KINDS_OF_CHARACTERS))
        return let(found, lambda f: F.when(F.size(f) > 0, kept(f)).otherwise(F.array().cast(spans)))

    n = F.char_length(token)
    whole = F.array(pair(F.lit(0), n))
    random = let(ratio(token, model), lambda r: (r > threshold) & (r > EACH * n)) & (kinds(whole[0]) >= KINDS_OF_CHARACTERS)
    return F.when(random, whole).otherwise(let(F.concat(F.array(F.lit(0)), F.transform(F.split(token, ""), F.ascii)), inner))


def _good(text: Column, kind: str) -> tuple[str, Column]:
    sizes = lambda regex, group, least: F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(group)), lambda m: F.char_length(m) >= least)
    if kind == "assign":
        return ASSIGN, sizes(ASSIGN, 2, 8)
    if kind == "access":
        return ACCESS, sizes(ACCESS, 0, 16)
    if kind == "hex":  # a maximal run of 32 or more: the same matches, without the many short ones
        return rf"(?<!{HEX[:-1]}){HEX[:-1]}{{32,}}+", sizes(rf"(?<!{HEX[:-1]}){HEX[:-1]}{{32,}}+", 0, 32)
    raise ValueError(kind)


THRESHOLD = 8.0
EACH = 0.25  # ratio for each character that a run needs beside the sum: long ordinary runs gather some by chance
LEAST = 16
KINDS_OF_CHARACTERS = 7  # that a secret has at least: rules, repeats and sequences of four letters aren't random however rare their pairs are


def _markov(text: Column, model: list[float], threshold: float) -> Column:
    """(s, e) of the secrets in each match of CANDIDATE, from the match's first character."""
    return F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda m: stretches(m, model, threshold))


def _placed(runs: Column, inner: Column) -> Column:
    """(s, e) in the text, of runs (s, e) there and the spans in each."""
    return F.flatten(F.zip_with(runs, inner, lambda run, own: F.transform(own, lambda x: F.struct((run["s"] + x["s"]).alias("s"), (run["s"] + x["e"]).alias("e")))))


def _marked(m: Column, own: Column) -> Column:
    """m with MARK in place of its spans."""
    end = F.aggregate(own, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["out"], m.substr(a["at"] + 1, x["s"] - a["at"]), F.lit(MARK)).alias("out")))
    return let(end, lambda a: F.concat(a["out"], m.substr(a["at"] + 1, F.char_length(m))))


def scan(df: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with n_assign, n_access, n_hex, n_markov and secret_spans, an array of (s, k, e): start, kind's place in KINDS, end; by start, then kind.

    A Markov span is a run of CANDIDATE whose log-likelihood ratio exceeds the threshold, or else a random stretch of such a run
    (see stretches), unless a base span has the same bounds. A null or empty text has no spans; columns that clash are replaced. Spans of copies are found for each row.
    """
    own = ["n_assign", "n_access", "n_hex", "n_markov", "secret_spans"]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = df.drop(*own).withColumns({f"_{k}": found(t, *_good(t, k)) for k in KINDS[:3]} | {"_markov": F.when(t.rlike(CANDIDATE), _placed(found(t, CANDIDATE), _markov(t, model, threshold))).otherwise(found(F.lit(""), CANDIDATE))})
    out = out.withColumn("_markov", F.array_except("_markov", F.concat("_access", "_hex")))
    tag = lambda i: lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))
    tagged = [F.transform(f"_{k}", tag(i)) for i, k in enumerate(KINDS)]
    out = out.withColumns({f"n_{k}": F.size(f"_{k}").cast("long") for k in KINDS} | {"secret_spans": F.array_sort(F.concat(*tagged))})
    return out.drop(*[f"_{k}" for k in KINDS])


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(df: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with MARK in place of each secret of its text; kind after kind, so a part that an earlier kind took isn't seen again. Null stays null."""
    out = df
    for k in KINDS:
        t = F.col(text)
        if k == "markov":
            regex = CANDIDATE
            parts = F.zip_with(F.regexp_extract_all(t, F.lit(regex), F.lit(0)), _markov(t, model, threshold), _marked)
        else:
            regex, good = _good(t, k)
            parts = F.zip_with(F.regexp_extract_all(t, F.lit(regex), F.lit(0)), good, lambda m, g: F.when(g, F.lit(MARK)).otherwise(m))
        whole = F.array_join(F.flatten(F.transform(F.arrays_zip(F.split(t, regex, -1).alias("p"), parts.alias("m")), lambda x: F.array(x["p"], F.coalesce(x["m"], F.lit(""))))), "")
        out = out.withColumn(text, F.when(t.rlike(regex), whole).otherwise(t))
    return out


def op2_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), train(labelled_samples(spark)))
    base = F.filter("secret_spans", lambda x: x["k"] < 3)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"), "n_markov")
