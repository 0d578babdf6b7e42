"""Company resolution and contact candidates through blocked joins: equal keys, domain suffixes, contained names and close spellings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import EMAIL, email_domain, filled, replaced, trimmed
from ..sources.tables import dealt_out, written
from .matching import plain

#: Free-mail domains, legal words of company names, and points.
GENERIC_DOMAINS = ["aol.com", "gmail.com", "googlemail.com", "hotmail.com", "icloud.com", "live.com", "me.com", "msn.com", "outlook.com", "proton.me", "protonmail.com", "yahoo.co.jp", "yahoo.com", "ymail.com"]
LEGAL_MARKERS = ["株式会社", "有限会社", "合同会社", "合資会社", "合名会社", "（株）", "(株)", "㈱"]
LEGAL_WORDS = ["co", "company", "corp", "corporation", "inc", "incorporated", "kk", "limited", "llc", "ltd", "株", "有", "同"]
POINTS = {"contact_email_match": 62, "company_name_exact": 46, "contact_name_exact": 40, "email_domain_match": 34, "company_name_variant": 28, "contact_name_variant": 22}
CLOSE_COMPANY, CLOSE_CONTACT = 0.82, 0.84
#: Free-mail domains where a company is inferred from a mail, signs that its keys leave out, and words of company names.
WEAK_DOMAINS = ["gmail.com", "googlemail.com", "yahoo.co.jp", "yahoo.com", "ymail.ne.jp", "outlook.com", "hotmail.com", "live.com", "icloud.com", "me.com", "mac.com", "aol.com", "proton.me", "protonmail.com", "zoho.com", "gmx.com", "mail.com", "example.com", "example.net", "example.org", "example.test", "localhost"]
KEY_LEAVES_OUT = "[株式会社有限会社合同会社合資会社（）()\\[\\]【】\"'`.,、。・\\s_-]"
COMPANY_WORDS = r"(?i)\b(?:inc|inc\.|ltd|ltd\.|llc|corp|corporation|co\.,?\s*ltd\.?|company|systems|solutions|technologies|technology|partners|consulting|group|holdings|labs|studio)\b|(?:株式会社|有限会社|合同会社|合資会社|（株）|\(株\)|㈱)"
PHONE = r"(?i)\b(?:tel|phone|fax)\b|(?:\+?\d[\d\s().-]{7,}\d)"
LINK = r"(?i)(?:https?://|www\.)\S+"
SIGNATURE_START = r"(?im)(?:^|\n)(?:--\s*$|Regards,?|Best regards,?|Sincerely,?|Thank you,?|敬具|以上)"


def company_key(c: Column) -> Column:
    """Lower-case letters and digits of a company name, without legal words."""
    base = replaced(F.lower(plain(F.coalesce(c, F.lit("")))), ("[&＆]", " and "), *((m.lower().replace("(", "\\(").replace(")", "\\)"), " ") for m in LEGAL_MARKERS), ("[^0-9a-z\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]+", " "))
    words = F.filter(F.split(base, " +"), lambda w: (w != "") & ~w.isin(LEGAL_WORDS))
    return F.array_join(words, "")


def company_sign_key(c: Column) -> Column:
    """Lower case without legal words' signs, brackets, points and blanks."""
    return F.regexp_replace(F.lower(plain(F.coalesce(c, F.lit("")))), KEY_LEAVES_OUT, "")


def compact_company_key(c: Column) -> Column:
    """The shorter form: trimmed, lower-case, without blanks."""
    return F.regexp_replace(F.lower(trimmed(c)), "\\s+", "")


def contact_key(c: Column) -> Column:
    base = replaced(F.lower(plain(F.coalesce(c, F.lit("")))), (r"\b(mr|mrs|ms|san|sama)\b", " "), ("[様殿氏]", " "))
    return F.regexp_replace(base, "[^0-9a-z\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]+", "")


def contact_keys(c: Column) -> Column:
    """The compact key, and for two or more Latin words their sorted join."""
    base = replaced(F.lower(plain(F.coalesce(c, F.lit("")))), (r"\b(mr|mrs|ms|san|sama)\b", " "), ("[様殿氏.,、。]", " "))
    latin = F.filter(F.split(base, "\\s+"), lambda w: w.rlike("^[a-z]+\\z"))
    keys = F.array(filled(contact_key(c)), F.when(F.size(latin) >= 2, F.array_join(F.array_sort(latin), "")))
    return F.array_distinct(F.array_compact(keys))


def is_generic(domain: Column) -> Column:
    return F.coalesce(F.lower(F.trim(domain)).isin(GENERIC_DOMAINS), F.lit(False))


def parent_domains(domain: Column) -> Column:
    """The domain and its parents that have a dot."""
    parts = F.split(domain, "\\.")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")), lambda d: F.contains(d, F.lit(".")))


def similarity(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def is_variant(a: Column, b: Column) -> Column:
    """One name holds the other (four characters or more), or both have six and are close."""
    shorter = F.least(F.length(a), F.length(b))
    held = (shorter >= 4) & (F.contains(a, b) | F.contains(b, a))
    return (a != b) & (a != "") & (b != "") & (held | ((shorter >= 6) & (similarity(a, b) >= CLOSE_COMPANY)))


def grams(c: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    return F.array_distinct(all_grams(c, n))


def all_grams(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))


def numbered_grams(c: Column, n: int) -> Column:
    """The runs of n characters, each with the number of the same ones up to it."""
    runs = all_grams(c, n)
    return F.transform(runs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(runs, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


def rarest(names: DataFrame, runs: DataFrame, counts: DataFrame, most: Column) -> DataFrame:
    """name and g: of each name (name, g in runs) the rarest runs by counts (g, n), as many as most says; ties by the run."""
    ranked = runs.join(counts, "g").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("all"))  # no more than the name's characters
    return ranked.join(names, "name").select("name", F.explode(F.slice("all", F.lit(1), most)).alias("x")).select("name", "x.g")


def contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text and name: distinct texts that hold a name. Both meet by the name's rarest run of eight characters (of four, if it is shorter), or by the whole of a name below four; a name of which no text has some run is in none."""
    texts, names = texts.select(F.col(texts.columns[0]).alias("text")).distinct(), names.select(F.col(names.columns[0]).alias("name")).distinct()
    met = []
    for n, below in ((1, 2), (2, 3), (3, 4), (4, 8), (8, None)):
        own = names.filter((F.length("name") >= n) & (F.lit(True) if below is None else F.length("name") < below))
        held = texts.filter(F.length("text") >= n).select("text", F.explode(grams(F.col("text"), n)).alias("g"))
        if n >= 4:
            runs = own.withColumn("runs", grams(F.col("name"), n)).select("name", F.size("runs").alias("of"), F.explode("runs").alias("g"))
            counts = held.groupBy("g").agg(F.count("*").alias("n"))
            best = runs.join(counts.hint("merge"), "g").groupBy("name", "of").agg(F.count("*").alias("known"), F.min(F.struct("n", "g")).alias("x"))
            own = best.filter(F.col("known") == F.col("of")).select("name", "x.g")
        else:
            own = own.withColumn("g", F.col("name"))
        met.append(held.join(own.hint("merge"), "g").filter(F.contains("text", "name")).select("text", "name"))
    return reduce(DataFrame.unionByName, met)


def without_one(c: Column) -> Column:
    """The text and what is left of it without one of its characters."""
    return F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))))


def shortened(c: Column, most: Column) -> Column:
    """Hashes of the text and of what is left of it without up to most (0 to 2) characters. Two texts of that many edits have one in common."""
    one, two = without_one(c), F.flatten(F.transform(without_one(c), without_one))
    left = F.when(most <= 0, F.array(c)).when(most == 1, one).otherwise(two)
    return F.array_distinct(F.transform(left, lambda x: F.xxhash64(x)))


#: Most edits for which names meet whole, and for which they meet by halves.
WHOLE, HALVES = 2, 5


def edit_keys(names: DataFrame, least: float, splits: bool) -> DataFrame:
    """name and k: keys of which two names have one in common if they differ in edits that least allows, HALVES at most.

    Names of up to WHOLE edits meet without as many characters. With more, one of two halves has half of the edits; the names of
    one side (splits) are cut in the middle, those of the other wherever the middle of a close name may lie.
    """
    size = F.length("name")
    edits = lambda n: F.floor(n * ((1 - least) / least) + 1e-9).cast("int")
    k = F.least(edits(size), F.lit(HALVES))
    whole = F.when((edits(size) > 0) & (edits(F.greatest(size - WHOLE, F.lit(0))) <= WHOLE), F.transform(shortened(F.col("name"), F.least(k, F.lit(WHOLE))), lambda x: F.struct(F.lit("whole").alias("part"), x.alias("h"))))
    spare = (k / 2).cast("int")

    def ends(part: str) -> Column:
        middle = (lambda n: F.floor(n / 2)) if part == "first" else (lambda n: n - F.floor(n / 2))
        piece = lambda n: F.substring(F.col("name"), F.lit(1) if part == "first" else (size - n + 1).cast("int"), n.cast("int"))
        sizes = F.array(middle(size)) if splits else F.sequence(F.greatest(middle(size - k) - spare, F.lit(0)), F.least(middle(size + k) + spare, size))
        return F.flatten(F.transform(sizes, lambda n: F.transform(shortened(piece(n), spare), lambda x: F.struct(F.lit(part).alias("part"), x.alias("h")))))

    halves = F.when((edits(size) > WHOLE) & (edits(F.greatest(size - HALVES, F.lit(0))) <= HALVES), F.concat(ends("first"), ends("last")))
    none = F.array().cast("array<struct<part:string,h:bigint>>")
    keys = F.array_distinct(F.concat(F.coalesce(whole, none), F.coalesce(halves, none)))
    return names.select("name", F.explode(keys).alias("k"))


def close_names(left: DataFrame, right: DataFrame, least: float, shortest: int = 1) -> DataFrame:
    """a and b: different names whose edit similarity is at least a value.

    Names that differ in HALVES edits at most meet by edit_keys. Of longer names, which differ in k, an edit changes two runs of two
    characters, so they share one of the 2 k + 1 rarest runs of each.
    """
    left, right = (dealt_out(df.select(F.col(df.columns[0]).alias("name")).filter(F.length("name") >= shortest).distinct(), 2_000) for df in (left, right))
    fits = (F.col("a") != F.col("b")) & (F.least(F.length("a"), F.length("b")) >= least * F.greatest(F.length("a"), F.length("b")) - 1e-9)
    keyed = [edit_keys(df, least, splits).withColumnRenamed("name", c) for df, splits, c in ((left, True, "a"), (right, False, "b"))]
    met = keyed[0].join(keyed[1].hint("merge"), "k").filter(fits).select("a", "b")
    edits = F.floor(F.length("name") * ((1 - least) / least) + 1e-9)
    left, right = left.filter(edits > HALVES), right.filter(edits > HALVES)
    runs = [df.select("name", F.explode(numbered_grams(F.col("name"), 2)).alias("g")) for df in (left, right)]
    counts = runs[0].unionByName(runs[1]).groupBy("g").agg(F.count("*").alias("n"))
    a, b = (rarest(df, r, counts, (2 * edits + 1).cast("int")).select(F.col("name").alias(c), "g") for df, r, c in ((left, runs[0], "a"), (right, runs[1], "b")))
    return met.unionByName(a.join(b, "g").filter(fits).select("a", "b")).distinct().filter(similarity(F.col("a"), F.col("b")) >= least)


def company_name(c: Column) -> Column:
    """A company's name out of a text: without tags, addresses, links, phone numbers, quotes and signs at its ends; null if nothing is left."""
    bare = replaced(c, ("\\r", ""), ("<[^>]*>", " "), (EMAIL, " "), (LINK, " "), (PHONE, " "), ("[\"'<>]", " "), ("\\s+", " "), ("^[\\s/|,;:-]+|[\\s/|,;:-]+$", ""))
    return F.substring(filled(trimmed(bare)), 1, 255)


def name_segment(from_name: Column) -> Column:
    """The first part of a sender's name that has a word of company names."""
    parts = F.transform(F.split(company_name(from_name), r"\s*(?:[|/｜／]| - | – | — )\s*"), company_name)
    return F.get(F.filter(parts, lambda p: p.rlike(COMPANY_WORDS)), F.lit(0))


def signature_part(signature: Column, body: Column) -> Column:
    """The signature, or the body from a closing word on, or its last twelve lines."""
    lines = F.split(body, "\n")
    tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - 11, F.lit(1)), 12), "\n")
    at = F.regexp_instr(body, F.lit(SIGNATURE_START))
    return F.coalesce(filled(trimmed(signature)), F.when(at > 0, F.substring(body, at, F.length(body))).otherwise(tail))


def signature_company(signature: Column) -> Column:
    names = F.transform(F.split(signature, "\n"), company_name)
    return F.get(F.filter(names, lambda x: x.rlike(COMPANY_WORDS)), F.lit(0))


def by_sender_domain(rows: DataFrame, companies: DataFrame, generic: list[str]) -> DataFrame:
    """mail_id and _by_domain (company_id, name): the first company whose domain is the sender's (_domain) or a parent of it."""
    known = companies.filter("domain IS NOT NULL").select(F.lower(F.trim("domain")).alias("_d"), F.struct("company_id", "name").alias("_c"))
    first = known.groupBy("_d").agg(F.min("_c").alias("_c"))
    senders = rows.filter(~F.col("_domain").isin(generic)).select("mail_id", F.explode(parent_domains(F.col("_domain"))).alias("_d"))
    return senders.join(first.hint("merge"), "_d").groupBy("mail_id").agg(F.min("_c").alias("_by_domain"))


def sender_company(mails: DataFrame, companies: DataFrame) -> DataFrame:
    """mail_id, company_id, company_name of the sender (from_name, from_email): by domain, or the first company whose compact name stands in name and address; null if none does."""
    base = mails.select("mail_id", email_domain(F.col("from_email")).alias("_domain"), compact_company_key(F.concat_ws(" ", "from_name", "from_email")).alias("_text"))
    named = companies.select("company_id", "name", compact_company_key(F.col("name")).alias("_key")).filter("_key != ''")
    held = contained(base.select("_text").filter("_text != ''"), named.select("_key"))
    first = named.groupBy("_key").agg(F.min(F.struct("company_id", "name")).alias("_c"))
    by_name = held.join(first.hint("merge"), held["name"] == first["_key"]).groupBy(F.col("text").alias("_text")).agg(F.min("_c").alias("_by_name"))
    out = base.join(by_sender_domain(base, companies, []).hint("merge"), "mail_id", "left").join(by_name.hint("merge"), "_text", "left")
    return out.select("mail_id", F.coalesce("_by_domain", "_by_name").alias("c")).select("mail_id", "c.company_id", F.col("c.name").alias("company_name"))


def infer_company(mails: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per mail (mail_id, from_email, from_name, label, signature and, if there, body): company_id, company_name, source, confidence, score.

    companies: company_id, name, domain; aliases: company_id, alias. Steps: the sender's domain or a parent of it is a company's;
    the longest alias of at least three characters stands in label, name or signature; the label; a part of the sender's name or a line
    of the signature with a word of company names; the domain's own word.
    """
    body = F.col("body") if "body" in mails.columns else F.lit(None).cast("string")
    base = mails.withColumns({"_domain": email_domain(F.col("from_email")), "_signature": signature_part(F.col("signature"), body)})
    base = base.withColumn("_text", company_sign_key(F.concat_ws(" ", "label", "from_name", "_signature")))
    named = aliases.select("company_id", company_sign_key(F.col("alias")).alias("_key")).filter(F.length("_key") >= 3).join(companies.select("company_id", "name").hint("merge"), "company_id")
    first = named.groupBy("_key").agg(F.min(F.struct("company_id", "name")).alias("_c"))
    held = contained(base.select("_text").filter("_text != ''"), named.select("_key"))
    pick = F.struct(F.length("_key").alias("n"), (-F.col("_c.company_id")).alias("o"), F.col("_c.company_id").alias("company_id"), F.col("_c.name").alias("name"))
    by_alias = held.join(first.hint("merge"), held["name"] == first["_key"]).groupBy(F.col("text").alias("_text")).agg(F.max(pick).alias("_by_alias"))
    out = base.join(by_sender_domain(base, companies, WEAK_DOMAINS).hint("merge"), "mail_id", "left").join(by_alias.hint("merge"), "_text", "left")
    labels = F.split("_domain", "\\.")
    root = F.element_at(labels, F.when(F.col("_domain").rlike(r"(^|\.)(co|ne|or|ac|go|ed|gr)\.jp$") & (F.size(labels) > 2), -3).when(F.size(labels) > 1, -2).otherwise(-1))
    own = F.when((F.length(root) > 2) & ~root.rlike("^(mail|smtp|mx|email|corp|co|ne|or|ac|go)$"), F.initcap(F.regexp_replace(root, "[-_]+", " ")))
    out = out.withColumns({"_label": company_name(F.col("label")), "_segment": name_segment(F.col("from_name")), "_line": signature_company(F.col("_signature")), "_own": own, "_weak": F.coalesce(F.col("_domain").isin(WEAK_DOMAINS), F.lit(False))})
    d, a = F.col("_by_domain").isNotNull(), F.col("_by_alias").isNotNull()
    way = F.when(d, "known_main_email_domain").when(a, "known_alias").when(F.col("_label").isNotNull(), "body_label").when(F.col("_segment").isNotNull(), "from_name").when(F.col("_line").isNotNull(), "signature_company").when(F.col("_weak"), "generic_domain").when(F.col("_own").isNotNull(), "sender_domain").otherwise("none")
    name = F.when(d, F.col("_by_domain.name")).when(a, F.col("_by_alias.name")).otherwise(F.coalesce("_label", "_segment", "_line", F.when(~F.col("_weak"), F.col("_own"))))
    out = out.withColumns({"source": way, "company_id": F.when(d, F.col("_by_domain.company_id")).when(a, F.col("_by_alias.company_id")), "company_name": name})
    sure = F.create_map(*(F.lit(x) for p in {"known_main_email_domain": 0.92, "known_alias": 0.88, "body_label": 0.86, "from_name": 0.72, "signature_company": 0.68, "generic_domain": 0.2, "sender_domain": 0.42, "none": 0.0}.items() for x in p))
    score = F.element_at(sure, F.col("source"))
    return out.select("mail_id", "company_id", "company_name", "source", F.when(score >= 0.86, "HIGH").when(score > 0.5, "MEDIUM").when(score > 0, "LOW").otherwise("NONE").alias("confidence"), score.alias("score"), F.col("_weak").alias("is_generic"))


def auto_apply(candidates: DataFrame) -> DataFrame:
    """Adds eligible and, if not, why (codes joined by ',')."""
    known = F.col("source").isin("known_main_email_domain", "known_alias")
    tests = [(F.col("company_name").isNull(), "NO_COMPANY_CANDIDATE_NAME"), (F.col("company_id").isNull(), "MISSING_EXISTING_COMPANY_ID_ADVISORY_ONLY"), (F.col("is_generic"), "GENERIC_DOMAIN_ADVISORY_ONLY"), (F.col("confidence") != "HIGH", "NON_HIGH_CONFIDENCE_ADVISORY_ONLY"), (~known, "NON_EXISTING_COMPANY_SOURCE_ADVISORY_ONLY")]
    reasons = F.concat_ws(",", *(F.when(t, c) for t, c in tests))
    return candidates.withColumns({"eligible": reasons == "", "why_not": reasons})


def contact_candidates(entities: DataFrame, contacts: DataFrame, most: int) -> DataFrame:
    """Ranked contacts for each entity (entity_id, company, email, contact) among contacts (contact_id, company, domain, email, contact; several rows of a contact are one candidate).

    A pair counts if it agrees in an e-mail, a domain or parent, a company key, or a contact key, or if a company name holds the
    other or is close to it. Close and contained names are looked for among distinct names, by rare runs of characters.
    """
    side = lambda rows, p: rows.select(F.col(rows.columns[0]).alias(f"{p}id"), company_key(F.col("company")).alias(f"{p}company"), F.lower(F.regexp_extract("email", f"({EMAIL})", 1)).alias(f"{p}email"), contact_key(F.col("contact")).alias(f"{p}contact"), contact_keys(F.col("contact")).alias(f"{p}keys"), F.coalesce(F.lower("domain") if "domain" in rows.columns else F.lit(None), email_domain(F.col("email"))).alias(f"{p}domain"))
    e, c = written(side(entities, "e_"), "entities"), written(side(contacts, "c_"), "contacts")
    block = lambda rows, p, key: rows.select(F.col(f"{p}id"), key.alias("k")).filter("k IS NOT NULL AND k != ''").distinct()
    pairs = []
    for ek, ck in (
        (F.col("e_email"), F.col("c_email")),
        (F.col("e_company"), F.col("c_company")),
        (F.explode("e_keys"), F.explode("c_keys")),
        (F.explode(parent_domains(F.when(~is_generic(F.col("e_domain")), F.col("e_domain")))), F.when(~is_generic(F.col("c_domain")), F.col("c_domain"))),
        (F.when(~is_generic(F.col("e_domain")), F.col("e_domain")), F.explode(parent_domains(F.when(~is_generic(F.col("c_domain")), F.col("c_domain"))))),
    ):
        pairs.append(block(e, "e_", ek).join(block(c, "c_", ck), "k").select("e_id", "c_id").distinct())
    names = lambda side, c: side.select(c).filter(f"{c} != ''")
    companies, others = names(e, "e_company"), names(c, "c_company")
    holds = contained(companies, others.filter(F.length("c_company") >= 4)).toDF("e_company", "c_company").unionByName(contained(others, companies.filter(F.length("e_company") >= 4)).toDF("c_company", "e_company"))
    near = holds.unionByName(close_names(companies, others, CLOSE_COMPANY, 6).toDF("e_company", "c_company")).distinct()
    pairs.append(e.select("e_id", "e_company").join(near, "e_company").join(c.select("c_id", "c_company"), "c_company").select("e_id", "c_id").distinct())
    people = close_names(names(e, "e_contact"), names(c, "c_contact"), CLOSE_CONTACT).toDF("e_contact", "c_contact")
    pairs.append(e.select("e_id", "e_contact").join(people, "e_contact").join(c.select("c_id", "c_contact"), "c_contact").select("e_id", "c_id").distinct())
    both = reduce(DataFrame.unionByName, pairs).distinct().join(e, "e_id").join(c, "c_id")
    ec, cc, en, cn = (F.col(x) for x in ("e_company", "c_company", "e_contact", "c_contact"))
    ends = lambda a, b: F.col(a).endswith(F.concat(F.lit("."), F.col(b)))
    tests = {
        "company_name_exact": (ec != "") & (ec == cc),
        "company_name_variant": is_variant(ec, cc),
        "contact_email_match": (F.col("e_email") != "") & (F.col("e_email") == F.col("c_email")),
        "email_domain_match": ~is_generic(F.col("e_domain")) & ~is_generic(F.col("c_domain")) & ((F.col("e_domain") == F.col("c_domain")) | ends("e_domain", "c_domain") | ends("c_domain", "e_domain")),
        "contact_name_exact": (en != "") & (en == cn),
        "contact_name_variant": (en != "") & (cn != "") & (en != cn) & (F.arrays_overlap("e_keys", "c_keys") | (similarity(en, cn) >= CLOSE_CONTACT)),
    }
    hit = {k: F.coalesce(t, F.lit(False)) for k, t in tests.items()}
    bits = sum((t.cast("int") * (1 << n) for n, t in enumerate(hit.values())), F.lit(0))
    scored = both.select("e_id", "c_id", "c_company", F.least(sum((POINTS[k] * t.cast("int") for k, t in hit.items()), F.lit(0)), F.lit(100)).alias("score"), bits.alias("bits")).filter("score > 0")
    # A contact's rows of one score unite their reasons; the best score of its rows counts.
    tied = scored.groupBy("e_id", "c_id", "score").agg(F.bit_or("bits").alias("bits"), F.min("c_company").alias("c_company"))
    best = tied.groupBy("e_id", "c_id").agg(F.max(F.struct("score", "bits", "c_company")).alias("x")).select("e_id", "c_id", "x.*")
    best = best.withColumn("reasons", F.concat_ws(",", *(F.when(F.col("bits").bitwiseAND(1 << n) > 0, k) for n, k in enumerate(hit))))
    order = Window.partitionBy("e_id").orderBy(F.desc("score"), F.desc(F.bit_count("bits")), "c_company", "c_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(F.col("e_id").alias("entity_id"), F.col("c_id").alias("contact_id"), "score", "reasons", "rank")


def find_or_create(names: DataFrame, companies: DataFrame) -> DataFrame:
    """company_id, key, name of names (name) that companies (company_id, key) lack: one for each key, with an id made from it."""
    keyed = names.select(compact_company_key(F.col("name")).alias("key"), "name").filter("key != ''")
    fresh = keyed.groupBy("key").agg(F.min("name").alias("name")).join(companies.select("key"), "key", "left_anti")
    return fresh.select(F.sha2("key", 256).alias("company_id"), "key", "name")


def find_or_create_contacts(people: DataFrame, contacts: DataFrame) -> DataFrame:
    """contact_id, company_id, name, email of people (company_id, name, email) that contacts lack: one for each company and e-mail, or name without one, with an id made from them."""
    key = lambda df: df.withColumn("_key", F.coalesce(filled(F.lower(trimmed(F.col("email")))), contact_key(F.col("name")))).filter("_key != ''")
    known = key(contacts).select("company_id", "_key").unionByName(contacts.select("company_id", contact_key(F.col("name")).alias("_key"))).distinct()
    named = key(people).withColumn("_name", contact_key(F.col("name")))
    fresh = named.join(known, ["company_id", "_key"], "left_anti").join(known.withColumnRenamed("_key", "_name"), ["company_id", "_name"], "left_anti")
    once = fresh.groupBy("company_id", "_key").agg(F.min(F.struct("name", "email")).alias("x"))
    return once.select(F.sha2(F.concat_ws("|", F.col("company_id").cast("string"), "_key"), 256).alias("contact_id"), "company_id", "x.name", "x.email")


def first_role(roles: DataFrame) -> DataFrame:
    """Of each project (project_id, role, sort_order, company_id) the role UPPER, else PRIME, else END_USER, else the first by order."""
    place = F.when(F.col("role") == "UPPER", 0).when(F.col("role") == "PRIME", 1).when(F.col("role") == "END_USER", 2).otherwise(3)
    return roles.groupBy("project_id").agg(F.min_by(F.struct("role", "company_id"), F.struct(place, "sort_order", "company_id")).alias("x")).select("project_id", "x.role", "x.company_id")


def latest_results(results: DataFrame) -> DataFrame:
    """The newest result (by created_at, then id) of each target type and id."""
    rest = [c for c in results.columns if c not in ("target_type", "target_id")]
    return results.groupBy("target_type", "target_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "result_id")).alias("x")).select("target_type", "target_id", "x.*")
