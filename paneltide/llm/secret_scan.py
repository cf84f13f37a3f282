"""Secret scan by multipart credential linking, in native Spark expressions only.

Strong patterns are reported as they are. Weak candidates (short or unlabelled parts, and
endpoints) are mostly noise alone, so each is reported only if the parts that would make it a
usable credential stand within the same scope: an access identifier needs a secret, a secret
needs an identifier, an endpoint needs both.

One pass over the texts takes the lengths of all matches and of what stands between them; no text
goes further. Their running sums are the parts' places. Linking is an interval join within each
text, done as a sweep: the parts' beginnings and the ends of the scopes that look for them are put
in one order, and the running maximum of the parts' ends tells each scope whether one reaches into
it. Sorting is all that it costs, however many parts a text has. Texts are named by 128 bits of
hash, so copies of a text share their parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

#: Weak parts. Runs of the right alphabet without a label, cut-off identifiers, and addresses.
WEAK_ID = r"AKIA[A-Z0-9]{6,}|(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}"
WEAK_SECRET = r"[A-Za-z0-9+/]{32,}={0,2}|[0-9a-f]{12,15}"
ENDPOINT = r"""https?://[^\s"'<>]{4,}|[a-z0-9-]+\.amazonaws\.com"""

#: ``ENDPOINT`` for one scan: a host begins where its run of characters does (or where the last match ended), so no run is read
#: from each of its positions. It has the same matches.
_ENDPOINT = r"""https?://[^\s"'<>]{4,}|(?:(?<![a-z0-9-])|\G)[a-z0-9-]++\.amazonaws\.com"""

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")


#: The patterns that are searched, by the kind of their matches; an ``assign`` match is judged by its value.
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}", "id": WEAK_ID, "secret": WEAK_SECRET, "endpoint": _ENDPOINT}
#: Characters of an assignment's value: from ``LONG`` on it is a base span, from ``SHORT`` on a weak secret.
LONG, SHORT = 12, 6

_SPAN = "struct<s:int,k:int,e:int>"
_KEY = ("_h1", "_h2")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """The row in ``row``, its text (null: empty) in ``_t`` and 128 bits of the text's hash."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.struct("*").alias("row"), t.alias("_t"), F.xxhash64(t).alias("_h1"), F.xxhash64(F.lit(1), t).alias("_h2"))


def find_parts(keyed: DataFrame) -> DataFrame:
    """(_h1, _h2, s, k, e): all parts of each text, base and weak, in code points; ``k`` counts :data:`KINDS`."""
    matches = [F.regexp_extract_all("_t", F.lit(p), F.lit(0)).alias(f"_m{k}") for k, p in enumerate(PATTERNS.values())]
    out = keyed.select(*_KEY, "_t", *matches)
    gaps = [F.when(F.size(f"_m{k}") > 0, F.transform(F.split("_t", p, -1), F.length)).alias(f"_g{k}") for k, p in enumerate(PATTERNS.values())]
    values = F.when(F.size("_m0") > 0, F.transform(F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2)), F.length)).alias("_v")
    lengths = [F.transform(f"_m{k}", F.length).alias(f"_m{k}") for k in range(len(PATTERNS))]
    out = out.select(*_KEY, *lengths, *gaps, values)

    def listed(k: int) -> Column:
        zipped = F.arrays_zip(F.slice(f"_g{k}", F.lit(1), F.size(f"_m{k}")).alias("g"), F.col(f"_m{k}").alias("m"), F.col("_v" if k == 0 else f"_m{k}").alias("v"))
        one = F.transform(zipped, lambda x, i: F.struct(F.lit(k).alias("p"), i.alias("i"), x["g"].alias("g"), x["m"].alias("m"), x["v"].alias("v")))
        return F.when(F.size(f"_m{k}") > 0, one).otherwise(F.array().cast("array<struct<p:int,i:int,g:int,m:int,v:int>>"))

    found = out.select(*_KEY, F.explode(F.concat(*[listed(k) for k in range(len(PATTERNS))])).alias("x")).select(*_KEY, "x.*")
    # Copies of a text have the same parts: they are told once, before anything is sent on.
    found = found.dropDuplicates([*_KEY, "p", "i"]).repartition(*_KEY)
    upto = Window.partitionBy(*_KEY, "p").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    e = F.sum(F.col("g") + F.col("m")).over(upto).cast("int")
    placed = found.withColumn("e", e).withColumn("s", F.col("e") - F.col("m"))
    k = F.when(F.col("p") != 0, F.col("p")).when(F.col("v") >= LONG, 0).when(F.col("v") >= SHORT, KINDS.index("secret"))
    return placed.select(*_KEY, "s", k.alias("k"), "e").filter("k IS NOT NULL")


def _reached(parts: DataFrame, tests: dict[str, tuple[Column, Column]], reach: int) -> DataFrame:
    """``parts`` with a flag for each test: a part that its first condition holds for begins before ``e + reach`` and ends
    after ``s - reach``. The second condition tells which parts ask. The row's own span never counts as its own answer,
    as no part both asks a test and answers it.
    """
    begin = F.struct(F.col("s").alias("at"), F.lit(1).alias("late"))
    ask = F.struct((F.col("e") + F.lit(reach)).alias("at"), F.lit(0).alias("late"))  # before what begins just there
    asks = F.lit(False)
    for _, asking in tests.values():
        asks = asks | asking
    events = parts.select("*", F.explode(F.when(asks, F.array(begin, ask)).otherwise(F.array(begin))).alias("_x"))
    sweep = Window.partitionBy(*_KEY).orderBy(F.col("_x.at"), F.col("_x.late")).rowsBetween(Window.unboundedPreceding, 0)
    for name, (answers, _) in tests.items():
        farthest = F.max(F.when(answers & (F.col("_x.late") == 1), F.col("e"))).over(sweep)
        events = events.withColumn(name, F.coalesce(farthest > F.col("s") - F.lit(reach), F.lit(False)))
    own = events.filter((F.col("_x.late") == 0) | ~asks)
    return own.drop("_x")


def link_parts(parts: DataFrame, reach: int = 200) -> DataFrame:
    """(_h1, _h2, base, spans): sorted spans of each text that has any: the base spans, and these with the weak parts
    whose complements stand at most ``reach`` code points away. Weak parts that touch a base span are left out: it stands already."""
    k = F.col("k")
    base = k <= KINDS.index("hex")
    clear = _reached(parts, {"_touch": (base, ~base)}, 0).filter(base | ~F.col("_touch")).drop("_touch")
    secret, ident = k.isin(0, 2, 4), k.isin(1, 3)
    near = _reached(clear, {"_secret": (secret, k.isin(3, 5)), "_ident": (ident, k.isin(4, 5))}, reach)
    linked = base | ((k == 3) & F.col("_secret")) | ((k == 4) & F.col("_ident")) | ((k == 5) & F.col("_secret") & F.col("_ident"))
    told = near.filter(linked).select(*_KEY, base.alias("_base"), F.struct("s", "k", "e").alias("x"))
    return told.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.when(F.col("_base"), F.col("x")))).alias("base"), F.array_sort(F.collect_list("x")).alias("spans"))


def scan(docs: DataFrame, text: str = "text", reach: int = 200) -> DataFrame:
    """``row``, ``base`` and ``spans`` (arrays of s, k, e; k counts :data:`KINDS`) of every row.

    Null and empty texts have no spans; texts of any length are read whole; spans that tie in their start are in the order
    of kinds; repeated rows are reported each; an empty table gives an empty table; columns of any other name stay inside ``row``.
    """
    return _joined(_keyed(docs, text).select("row", *_KEY), link_parts(find_parts(_keyed(docs.select(text), text)), reach))


def _joined(rows: DataFrame, links: DataFrame) -> DataFrame:
    none = F.array().cast(f"array<{_SPAN}>")
    return rows.join(links, [*_KEY], "left").select("row", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def as_text(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows, one for each row of ``docs``; null and empty texts have no span, other columns are ignored. See :func:`scan`."""
    links = link_parts(find_parts(_keyed(docs.select("text"), "text")))
    out = _joined(_keyed(docs.select("doc_id", "text"), "text").select(F.struct(F.col("row.doc_id")).alias("row"), *_KEY), links)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(as_text("base"), 256).alias("base_sha256"),
        as_text("spans").alias("spans"),
    )
