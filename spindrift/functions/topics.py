"""What a question asks about whom, what a statement says about whom, and whether the one answers the other.

Both are read into an entity and an attribute by column expressions: a question by the first of some forms that it fits, a
statement by the names and the words of known relations in its first sentence. What can't be read is null, and a
pair with a null where it matters has no verdict, so nothing is held against a record that isn't understood.

Defined results: a null or empty text has no topic; words are cut at white space and lose punctuation at their ends; names are words
that start with A to Z, hold no digit and aren't all capitals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of each attribute, in their base form; phrases come before words.
ATTRIBUTES = {
    "phone": "phone smartphone device mobile use app",
    "location": "live reside location dwell city town",
    "birthplace": "born birthplace hometown raise",
    "employer": "work employer job occupation profession employ workplace residency internship fellowship",
    "school": "school study education university college degree graduate",
    "color": "color colour",
    "movie": "movie film",
    "book": "book read",
    "food": "food eat meal cuisine diet cook lunch dinner breakfast snack",
    "allergy": "allergy allergic",
    "drink": "drink beverage wine coffee tea beer",
    "sport": "sport play exercise jog swim athletic marathon training racing race workout gym fitness triathlon cycling",
    "pace": "pace speed tempo split pb",
    "team": "team support fan",
    "car": "car drive vehicle",
    "brand": "brand branded manufacturer",
    "expiration": "expire expiry expiration expires",
    "breed": "breed",
    "salary": "salary income wage earn",
    "instrument": "instrument",
    "language": "language speak fluent",
    "pet": "own pet cat dog",
    "collection": "collect collection hobby",
    "mentorship": "mentor coach supervisor manage manager",
    "name": "name called wife husband mother father",
    "family": "sibling brother sister family children kid son daughter",
}
PHRASES = {
    "grow up": "birthplace", "grew up": "birthplace", "growing up": "birthplace", "favorite color": "color", "favourite colour": "color",
    "food allergy": "allergy", "personal best": "pace", "reports to": "mentorship",
}
#: Attributes that a question may have; nothing in a text makes one of "person".
ASKABLE = (*ATTRIBUTES, "person")
ARTICLES = "the a an"
OPENERS = (
    "my the a an we it this that these those there i he she they his her their our its during until since after before as in on at from "
    "decision preference preference: fact observation context note todo weekly nightly"
)
CALENDAR = "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday"
AFTER_GERUND = "up in into on at from through around about the a an my our their his her"
ABBREVIATIONS = "Mr Mrs Ms Dr Prof St Sr Jr vs etc"
# End of the fixed values.



def _either(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def _any_of(words: list[str]) -> str:
    """A pattern of just these words that shares their common beginnings, so that it gives up on another word at once."""
    rest: dict[str, list[str]] = {}
    for w in words:
        if w:
            rest.setdefault(w[0], []).append(w[1:])
    return f"(?:{'|'.join(c + _any_of(ends) for c, ends in rest.items())})" + ("?" if "" in words else "") if rest else ""


def inflected(base: str) -> list[str]:
    """The forms that count as the word: plural, third person, past and -ing forms as regular English makes them."""
    forms = [base]
    if not base.endswith("s"):
        forms += [base + "s"] if len(base) > 1 else []
    if base.endswith("y"):
        forms += [base[:-1] + "ies", base[:-1] + "ied"]
    if base.endswith("e"):
        forms.append(base + "d")
    forms += [base + "es", base + "ed"]
    if len(base) > 2:
        forms += [base + "ing", base + base[-1] + "ing"]
    return forms


def _forms() -> dict[str, str]:
    """Attribute by word form; a base form is never another word's inflection."""
    bases = {w: a for a, words in ATTRIBUTES.items() for w in words.split()}
    out = dict(bases)
    for w, a in bases.items():
        for f in inflected(w):
            out.setdefault(f, a)
    return out


FORMS = _forms()

END = "(?= |$)"
#: Ends of words of a raw text, which are those of ASCII letters, digits and underscores.
_WORD, _DROW = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: A word of a cleaned text that can be (part of) a name.
NAME = rf"(?=[A-Z])(?![^ ]*\d)(?!(?:[^A-Za-z ]*[A-Z]){{2}}[^a-z ]*{END})[^ ]+"
RUN = rf"{NAME}(?: {NAME})*"
_FORM = rf"(?<![^ ])({_any_of(list(FORMS))})(?: (the|a|an))?{END}"
_PHRASE = rf"(?<![^ ])({'|'.join(PHRASES)}){END}"
#: Before a verb within a question: "Does" after a word without a capital is a name.
_VERB = rf"(?:(?!(?-i:[A-Z][a-z]))|(?<={_WORD}(?-i:[A-Z])[A-Za-z0-9_]{{0,40}} ))"
#: Up to the first end of a sentence that isn't an abbreviation's dot.
_SENTENCE = rf"^[^.!?\n;]*+(?:(?<={_WORD}(?:{'|'.join(ABBREVIATIONS.split())}))\.(?=\s)[^.!?\n;]*+)*+"
_MONTH = rf"(?i:{'|'.join(CALENDAR.split())})"
#: The first name of a statement: not an opener or a gerund at its start, nor a date.
_SUBJECT = (
    rf"(?<![^ ])(?!^(?i:{'|'.join(OPENERS.split())}){END})(?!^[^ ]*(?i:ing) (?![A-Z])(?i:{'|'.join(AFTER_GERUND.split())}){END})"
    rf"(?!{_MONTH}(?: (?:19|20)\d\ds?{END}|$))({NAME}(?: (?!{_MONTH}{END}){NAME})*)"
)


def cleaned(text: Column) -> Column:
    """The words, without punctuation at their ends, joined by single spaces."""
    return F.array_join(F.filter(F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, "^[^A-Za-z0-9]+|[^A-Za-z0-9']+$", "")), lambda w: w != ""), " ")


def _let(value: Column, body) -> Column:
    """body of the value, which is evaluated once however often body reads it."""
    return F.transform(F.array(value), body)[0]


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _mapped(key: Column, values: dict[str, str]) -> Column:
    known = F.map_from_arrays(F.split(F.lit(",".join(values)), ","), F.split(F.lit(",".join(values.values())), ","))  # a constant
    return F.try_element_at(known, key)


def attribute(words: Column, plays: bool = False) -> Column:
    """Attribute of the first known phrase, else the first known word, of cleaned lower-case words; null without one.
    plays: "plays the ..." is an instrument."""
    by_word = _mapped(_found(words, _FORM), FORMS)
    if plays:
        by_word = _let(F.struct(_found(words, _FORM).alias("form"), _found(words, _FORM, 2).alias("article")), lambda x: F.when(x["form"].isin("play", "plays") & x["article"].isNotNull(), "instrument").otherwise(_mapped(x["form"], FORMS)))
    return F.coalesce(_mapped(_found(words, _PHRASE), PHRASES), by_word)


def _without_possessive(name: Column) -> Column:
    """Of a question: "Priya's" and "Priyas" are Priya."""
    name = F.regexp_replace(name, "'s$", "")
    return F.when((F.length(name) > 3) & ~name.rlike("[A-Z]{2}"), F.regexp_replace(name, "s$", "")).otherwise(name)


def _last_without_possessive(name: Column) -> Column:
    head, last = F.regexp_extract(name, "^(.* )?", 1), F.regexp_extract(name, "([^ ]*)$", 1)
    return F.concat(head, _without_possessive(last))


def asked(question: Column) -> Column:
    """entity, attribute and role of a question. An unknown attribute is the words that ask for it; role is "object" where
    the entity isn't whom the answer is about."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(question, r"\s+", " ")), r'[.,;:!?"()\[\]{}]+$', ""), r"""^["'(\[]+""", "")
    first = lambda words: _found(words, f"^({RUN})")
    after = lambda words: F.trim(F.regexp_replace(words, f"^{RUN}", ""))
    unnamed = lambda words: F.regexp_replace(words, rf"(?<![^ ]){NAME}", "")  # noqa: E731, a name such as Beer isn't what is asked
    born = lambda words: F.lower(unnamed(words)).rlike(_WORD + "(born|grow|grew|grown|growing)" + _DROW)
    none = F.lit(None).cast("string")

    def read(entity, words=none, fixed=none, role=none, rule="any") -> Column:
        return F.struct(F.lower(entity).alias("entity"), words.alias("words"), fixed.alias("fixed"), role.alias("role"), F.lit(rule).alias("rule"))

    nothing = read(none)

    def form(pattern: str, reading, ask: int = 0, of: int = 1):
        """A form of questions: reading(words, first name in them, what is asked), from the pattern's groups `of` and `ask`."""

        def tried(t: Column) -> Column:
            rest = cleaned(F.regexp_extract(t, pattern, of))
            asks = cleaned(F.regexp_extract(t, pattern, ask)) if ask else none
            return _let(F.struct(rest.alias("rest"), asks.alias("asks")), lambda x: _let(F.struct(x["rest"].alias("rest"), first(x["rest"]).alias("name"), x["asks"].alias("asks")), lambda y: reading(y["rest"], y["name"], y["asks"])))

        return lambda t: F.when(t.rlike(pattern), tried(t))

    def where(rest, name, asks) -> Column:
        return F.when(name.isNull(), nothing).when(born(rest), read(name, fixed=F.lit("birthplace"))).otherwise(read(name, rest, rule="place") if asks is none else read(name, asks))

    def who(rest, name, asks) -> Column:
        whom = _found(rest, rf"^[^ ]+ (?:.*? )??(?<![^ ])({RUN})")
        return _let(F.struct(whom.alias("whom")), lambda x: read(x["whom"], F.regexp_extract(rest, "^([^ ]+)", 1), role=F.when(x["whom"].isNotNull(), "object"), rule="person"))

    def what_is(rest, name, asks) -> Column:
        one = F.when(~rest.rlike("^[A-Z]"), nothing).when(~rest.contains(" "), read(_without_possessive(rest)))
        return one.when(name.isNull(), nothing).otherwise(read(_last_without_possessive(name), after(rest)))

    def what(rest, name, asks) -> Column:
        late = _found(rest, rf"^(?:[^ ]+ ){{2,}}?({RUN})")
        told = read(late, F.regexp_extract(rest, rf"^((?:[^ ]+ ){{2,}}?){NAME}", 1), role=F.lit("object"))
        return F.when(rest.rlike(rf"(?i)(?<![^ ])(?:^|{_VERB})(?:{be}|{do}){END}") | late.isNull(), nothing).otherwise(told)

    do, be, which = r"(?:does|do|did)", r"(?:is|are|was|were)", r"(?:what|which)"
    named = lambda rest, name, asks: F.when(name.isNull(), nothing).otherwise(read(name, asks))
    forms = [
        form(rf"(?i)^{which}\s+(.+?)\s+{_VERB}{do}\s+(.+)$", lambda rest, name, asks: F.when(name.isNotNull(), read(name, asks)).when(~asks.rlike(rf"(?i){_WORD}{do}{_DROW}"), read(none, asks, rule="known")), 1, 2),
        form(rf"(?i)^{which}\s+(.+?)\s+{_VERB}(?:is|are)\s+(.+)$", lambda rest, name, asks: read(_without_possessive(name), asks, rule="narrow"), 1, 2),
        form(rf"(?i)^when\s+(?:{do}|{be})\s+(.+)$", lambda rest, name, asks: read(none, rest, rule="changed")),
        form(rf"(?i)^what\s+{do}\s+(.+)$", lambda rest, name, asks: F.when(name.isNotNull(), read(name, after(rest))).otherwise(nothing)),
        form(rf"(?i)^where\s+(?:{do}|{be})\s+(.+)$", lambda rest, name, asks: where(rest, name, none)),
        form(rf"(?i)^(?:(?:in|at|on|to|by|near|around)\s+)?{which}\s+(.+?)\s+{_VERB}(?:was|were|{do})\s+(.+)$", where, 1, 2),
        form(rf"(?i)^how\s+(?:many|much)\s+(.+?)\s+{do}\s+(.+)$", named, 1, 2),
        form(rf"(?i)^{which}\s+(?:is|are)\s+the\s+(.+?)\s+of\s+(.+)$", named, 1, 2),
        form(rf"(?i)^who\s+{be}\s+(.+)$", lambda rest, name, asks: read(name, fixed=F.lit("person"))),
        form(r"(?i)^who\s+([^?]+)$", who), form(rf"(?i)^{which}\s+(?:is|are)\s+([^?]+)$", what_is), form(rf"(?i)^{which}\s+([^?]+)$", what),
    ]

    def worded(x: Column) -> Column:
        plain = lambda words: F.trim(F.regexp_replace(F.regexp_replace(F.lower(words), rf"(?<![^ ]){_either(ARTICLES)}{END}", ""), " +", " "))
        words = plain(x["words"])
        changed = F.when(x["rule"] == "changed", attribute(plain(unnamed(x["words"]))))
        return F.struct(x.alias("x"), words.alias("words"), F.coalesce(changed, attribute(words)).alias("own"))

    def decided(y: Column) -> Column:
        x, words, own = y["x"], y["words"], y["own"]
        free = F.coalesce(own, F.nullif(words, F.lit("")))
        value = (
            F.when(x["fixed"].isNotNull(), x["fixed"]).when(x["rule"] == "place", F.coalesce(_mapped(_found(F.lower(unnamed(x["words"])), _FORM), FORMS), F.lit("location")))
            .when(x["rule"] == "person", F.coalesce(_mapped(_found(words, rf"^({'|'.join(FORMS)})$"), FORMS), F.lit("person")))
            .when(x["rule"] == "known", F.when(free.isin(*ASKABLE), free)).when(x["rule"] == "narrow", F.when(own.isin("brand", "breed"), own))
            .when(x["rule"] == "changed", F.when(free != F.lower(x["words"]), free)).otherwise(free)
        )
        entity = F.when((x["rule"] == "narrow") & ~F.coalesce(own.isin("brand", "breed"), F.lit(False)), None).otherwise(x["entity"])
        return F.struct(entity.alias("entity"), value.alias("attribute"), x["role"].alias("role"))

    return _let(_let(_let(text, lambda t: F.coalesce(*(f(t) for f in forms), nothing)), worded), decided)


def stated(content: Column) -> Column:
    """entity, attribute and first_person of a statement's first sentence."""
    whole = F.trim(F.coalesce(content, F.lit("")), F.lit(" \t\n\r\f\v"))
    sentence = cleaned(F.regexp_extract(whole, _SENTENCE, 0))

    def read(s: Column) -> Column:
        name = F.lower(F.regexp_replace(_found(s["words"], _SUBJECT), "'s$", ""))
        first = whole.rlike(r"^(?i:my|our|i|we)\s") & (s["words"] != "")
        return F.struct(name.alias("entity"), attribute(F.lower(s["words"]), plays=True).alias("attribute"), first.alias("first_person"))

    return _let(F.struct(sentence.alias("words")), read)


def carries(content: Column, of: Column) -> Column:
    """Whether any word or phrase of the whole text states the attribute `of`."""
    words = F.lower(cleaned(F.coalesce(content, F.lit(""))))
    patterns = {a: "|".join([p for p, b in PHRASES.items() if b == a] + [f for f, b in FORMS.items() if b == a]) for a in ATTRIBUTES}
    return F.coalesce(*(F.when(of == a, words.rlike(rf"(?<![^ ])(?:{p}){END}")) for a, p in patterns.items()), F.lit(False))


def same_entity(a: Column, b: Column) -> Column:
    """Equal, or one (of three characters at least) within the other."""
    return (a == b) | (a.contains(b) & (F.length(b) >= 3)) | (b.contains(a) & (F.length(a) >= 3))


def mentions(content: Column, entity: Column) -> Column:
    """Whether the text holds the entity as whole words; only names of letters, digits and apostrophes are looked for."""
    plain = entity.rlike(r"^[\p{L}\p{N}' ]+$")
    return F.when(plain, F.regexp_like(content, F.concat(F.lit("(?i)" + _WORD), entity, F.lit(_DROW)))).otherwise(False)


def alignment(question: Column, statement: Column, content: Column) -> Column:
    """1 if the statement is about the asked attribute of the entity, 0.7 if only part of it is or the entity is only mentioned,
    0 if it can't be the answer, null if that can't be told. The arguments are results of asked and stated."""
    q, m = question, statement
    same = same_entity(q["entity"], m["entity"])
    part = q["attribute"].contains(m["attribute"]) | m["attribute"].contains(q["attribute"])
    subject = q["role"].isNull() & q["attribute"].isNotNull()
    return (
        F.when(m["first_person"] & q["entity"].isNotNull(), 0.0)
        .when(subject & ~same, F.when(mentions(content, q["entity"]), 0.7).otherwise(0.0))
        .when(q["entity"].isNull() | m["entity"].isNull() | q["attribute"].isNull() | m["attribute"].isNull(), None)
        .when(~same, 0.0).when(q["attribute"] == m["attribute"], 1.0).when(part, 0.7).otherwise(0.0)
    )
