"""Normal forms of mail texts, addresses, subjects and search terms, as column expressions.

White space is spelled out where the jobs' texts have more than ASCII; Java's letter case is asked for
with (?iu), and the end of a text with \\z.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = "[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
#: The same signs, one by one.
WHITE_SIGNS = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: Named entities, marks of signatures in order, and compounds that a search for sql finds.
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}
SIGNATURES = ["-- ", "――", "-----Original Message-----", "差出人:"]
SQL_COMPOUNDS = ["mysql", "postgresql", "mssql", "plsql", "tsql", "sqlserver"]


def replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    """Regular expressions replaced one after the other."""
    for pattern, by in pairs:
        c = F.regexp_replace(c, pattern, by)
    return c


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SIGNS))


def filled(c: Column) -> Column:
    """Null for an empty text. NULLIF would work c out twice, and what it is made of again and again."""
    return F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that it names several times, which is worked out once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def body_text(c: Column) -> Column:
    """Line ends without blanks, runs of blanks as one, one empty line at most; null if nothing is left. One look tells texts of which nothing is replaced."""
    plain = F.replace(F.replace(c, F.lit("\r"), F.lit("")), F.lit("\u00a0"), F.lit(" "))
    loose = lambda x: replaced(x, ("[ \\t]+\\n", "\n"), ("\\n[ \\t]+", "\n"), ("[ \\t]{2,}", " "), ("\\n{3,}", "\n\n"))
    return filled(trimmed(once(plain, lambda x: F.when(x.rlike("[ \\t][ \\t\\n]|\\n(?:[ \\t]|\\n\\n)"), loose(x)).otherwise(x))))


def search_text(c: Column) -> Column:
    return filled(trimmed(replaced(c, (f"{WHITE}+", " "))))


def decoded(c: Column) -> Column:
    """Numeric entities become characters, then the six named ones; others stay.

    Each numeric entity is cut out with the text after it: the parts are joined by what the codes mean.
    """
    parts = F.split(c, "&#", -1)
    code = "^(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));"

    def part(x: Column) -> Column:
        number = F.coalesce(F.conv(filled(F.regexp_extract(x, code, 1)), 16, 10), filled(F.regexp_extract(x, code, 2))).cast("int")
        utf16 = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(x.rlike(code) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF), F.concat(utf16, F.regexp_replace(x, code, ""))).otherwise(F.concat(F.lit("&#"), x))

    joined = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), part), ""))
    out = F.when(F.contains(c, F.lit("&#")), joined).otherwise(c)
    for name, value in ENTITIES.items():
        if name != "amp":
            out = F.regexp_replace(out, f"(?i)&{name};", value)
    return F.regexp_replace(out, "(?i)&amp;", "&")


def html_text(c: Column) -> Column:
    """What a reader sees of HTML: comments, styles and scripts go, blocks end lines, items start with a dash."""
    bare = replaced(
        c,
        ("<!--[\\s\\S]*?-->", " "),
        ("(?i)<style[\\s\\S]*?</style>", " "),
        ("(?i)<script[\\s\\S]*?</script>", " "),
        ("(?i)<br\\s*/?>", "\n"),
        ("(?i)</(p|div|li|tr|h[1-6]|section|article|table)>", "\n"),
        ("(?i)<li[^>]*>", "\n- "),
        ("<[^>]+>", " "),
    )
    return body_text(decoded(bare))


def says_little(c: Column) -> Column:
    """Null, or nothing but links, view-in-browser phrases and signs. A text with a letter or digit, but none of the phrases' words, says something."""
    sure = c.rlike("[\\p{L}\\p{N}]") & ~c.rlike("(?=[hHvVbB表こブ])(?i:http|view|browser|表示|こちら|ブラウザ)")
    kept = replaced(
        F.coalesce(search_text(c), F.lit("")),
        ("(?i)https?://\\S+", " "),
        ("表示されない場合はこちら|表示できない場合はこちら|ブラウザで表示", " "),
        ("表示されない|表示できない|こちら|ブラウザ", " "),
        ("(?i)\\b(?:view(?: this)? email(?: in your browser)?|view online|open in (?:a )?browser|browser)\\b", " "),
        ("[!-/:-@\\[-`{-~\\s]+", ""),
    )
    return F.when(sure, F.lit(False)).otherwise(once(kept, lambda x: (x == "") | ((F.length(x) <= 80) & ~x.rlike("[\\p{L}\\p{N}]"))))


def link_only(c: Column) -> Column:
    """A short text around a link that leads to the real one."""
    text = F.coalesce(search_text(c), F.lit(""))
    rest = trimmed(replaced(text, ("(?i)https?://\\S+", ""), (f"{WHITE}+", " ")))
    hint = text.rlike("(?iu)表示されない|表示できない|こちら|ブラウザ|browser|view online|view this email")
    return (F.length(text) <= 300) & text.rlike("(?i)https?://\\S+") & (hint | (F.length(rest) <= 80))


def best_body(text: Column, html: Column) -> tuple[Column, Column]:
    """The body that says more and where it comes from; both already normalised."""
    good_html = html.isNotNull() & ~says_little(html)
    pick_html = (says_little(text) & good_html) | (good_html & link_only(text) & (F.length(html) >= F.greatest(F.lit(200), F.length(text) + 100)))
    pick_text = ~says_little(text)
    return F.when(pick_html, html).when(pick_text, text), F.when(pick_html, "text/html").when(pick_text, "text/plain").otherwise("none")


def extraction_body(text: Column, html: Column, *others: Column) -> Column:
    """The best body, or the first of the other columns that says something."""
    best, _ = best_body(body_text(text), html_text(html))
    return F.coalesce(best, *(F.when(~says_little(body_text(o)), body_text(o)) for o in others))


def addresses(header: Column) -> Column:
    """E-mail addresses of an address list: split at commas outside quotes."""
    parts = F.split(F.coalesce(header, F.lit("")), ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    mails = F.transform(parts, lambda p: F.lower(F.coalesce(filled(F.regexp_extract(p, f"<\\s*({EMAIL})\\s*>", 1)), F.regexp_extract(p, EMAIL, 0))))
    return F.filter(mails, lambda m: m != "")


def first_name(header: Column) -> Column:
    """The display name of the first address."""
    first = F.element_at(F.split(header, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), 1)
    return filled(trimmed(replaced(first, ("<[^>]*>", ""), ('"', ""), (EMAIL, ""))))


def email_domain(address: Column) -> Column:
    return filled(F.lower(F.trim(F.substring_index(F.when(F.contains(address, F.lit("@")), address), "@", -1))))


def site_domain(value: Column) -> Column:
    """Of an address or link, the host without scheme, www. and path; null without a dot."""
    host = replaced(F.lower(F.trim(F.substring_index(value, "@", -1))), ("^https?://", ""), ("^www\\.", ""), ("[/?#:].*$", ""))
    return F.when(F.contains(host, F.lit(".")), host)


def body_hash(text: Column, html: Column) -> Column:
    return F.sha2(F.coalesce(filled(text), html), 256)


def is_reply(subject: Column, in_reply_to: Column, references: Column, forwarded: bool = False) -> Column:
    """Told by headers or by the subject's beginning; forwarded: fwd: counts too."""
    start = F.lower(trimmed(F.coalesce(subject, F.lit(""))))
    named = F.startswith(start, F.lit("re:")) | (F.startswith(start, F.lit("fwd:")) if forwarded else F.lit(False))
    return filled(in_reply_to).isNotNull() | filled(references).isNotNull() | named


def without_signature(c: Column) -> Column:
    """Cut before the first mark, in the order of marks, that stands after character 240."""
    out = c
    for mark in reversed(SIGNATURES):
        out = F.when(F.instr(c, mark) > 241, trimmed(F.substring(c, F.lit(1), F.instr(c, mark) - 1))).otherwise(out)
    return out


def clean_subject(c: Column, otherwise: str = "Gmail取込案件") -> Column:
    text = trimmed(replaced(F.coalesce(c, F.lit("")), ("(?i)^\\s*(re|fw|fwd)\\s*:\\s*", ""), ("\\[SES配信\\]", ""), ("【株式会社SKV様】", ""), (f"{WHITE}+", " ")))
    return F.coalesce(filled(F.substring(text, 1, 255)), F.lit(otherwise))


def redacted(c: Column, most: int | None = None) -> Column:
    """Database links, bearer tokens and secret=value pairs masked, blanks collapsed, cut to most characters if given."""
    text = replaced(
        F.coalesce(c, F.lit("")),
        ("(?i)postgres(?:ql)?://\\S+", "[redacted-database-url]"),
        ("(?i)Bearer\\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]"),
        ("(?i)(client_secret|refresh_token|access_token|reset_token|resetToken|password|token|secret)=([^&\\s]+)", "$1=[redacted]"),
        ("(?i)(DATABASE_URL)\\s*[:=]\\s*[^\\s,;]+", "$1=[redacted]"),
        (f"{WHITE}+", " "),
    )
    return trimmed(text) if most is None else F.substring(trimmed(text), 1, most)


def subject_mark(c: Column) -> Column:
    """Length and short hash instead of a subject."""
    return F.when(F.coalesce(c, F.lit("")) == "", "(no subject)").otherwise(F.format_string("[redacted-subject len=%d hash=%s]", F.length(c), F.substring(F.sha2(c, 256), 1, 12)))


def matches_term(text: Column, term: str) -> Column:
    """Search rule: long terms as they are; up to three ASCII letters or digits only between other signs, but sql within known compounds too."""
    hay, needle = F.lower(trimmed(F.coalesce(text, F.lit("")))), term.strip().lower()
    if not needle:
        return F.lit(True)
    if not (needle.isascii() and needle.isalnum() and len(needle) <= 3):
        return F.contains(hay, F.lit(needle))
    found = hay.rlike(f"(?<![a-z0-9]){needle}(?![a-z0-9])")
    if needle == "sql":
        tokens = F.regexp_extract_all(hay, F.lit("([a-z0-9][a-z0-9.+#-]*)"))
        found |= F.exists(tokens, lambda t: F.regexp_replace(t, "[^a-z0-9]", "").isin(SQL_COMPOUNDS))
    return found


def epoch_time(ms: Column, header_date: Column) -> Column:
    """Milliseconds since 1970, or a header's date; null if neither can be read."""
    date = F.regexp_replace(header_date, r"^\w{3},\s*|\s*\(.*\)$", "")
    return F.coalesce(F.timestamp_millis(ms.try_cast("long")), F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss Z")))
