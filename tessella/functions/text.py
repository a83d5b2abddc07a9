"""Text functions as column expressions: answers, tokens, templates, rewrite rules."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = string.punctuation
ARTICLES = ("a", "an", "the")


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value made once a row: an expression that a lambda looks into is otherwise made anew for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def tokens(text: Column) -> Column:
    """Words between Unicode white space, empty ones dropped; null gives null."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def normalize_answer(text: Column) -> Column:
    """Lower case, ASCII punctuation deleted, articles dropped, white space collapsed, in that order.

    Articles are dropped as tokens. A word boundary between a non-ASCII punctuation mark and an article would differ.
    """
    return F.array_join(answer_tokens(text), " ")


def answer_tokens(text: Column) -> Column:
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.filter(tokens(plain), lambda w: ~w.isin(*ARTICLES))


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("int")


def multiset_overlap(left: Column, right: Column) -> Column:
    """Tokens that two arrays share, each as often as in the one that has it less often."""
    times = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    return F.aggregate(F.array_distinct(F.array_intersect(left, right)), F.lit(0), lambda n, w: n + F.least(times(left, w), times(right, w)))


SPECIAL_ANSWERS = ("yes", "no", "noanswer")


def token_f1(prediction: Column, gold: Column) -> Column:
    """Struct f1, precision, recall. No overlap gives 0, also for two empty answers; a yes, no or noanswer that
    the other side does not equal gives 0."""
    return f1_of_tokens(answer_tokens(prediction), answer_tokens(gold))


def f1_of_tokens(p: Column, g: Column) -> Column:
    """token_f1 of answers that are tokens already: columns, so that they are worked out once."""
    np_, ng = F.array_join(p, " "), F.array_join(g, " ")
    common = multiset_overlap(p, g)
    clash = (np_ != ng) & (np_.isin(*SPECIAL_ANSWERS) | ng.isin(*SPECIAL_ANSWERS))
    none = clash | (common == 0)
    precision, recall = common / F.size(p), common / F.size(g)
    zero = F.lit(0.0)
    return F.struct(F.when(none, zero).otherwise(2 * precision * recall / (precision + recall)).alias("f1"), F.when(none, zero).otherwise(precision).alias("precision"), F.when(none, zero).otherwise(recall).alias("recall"))


def token_f1_with_empty(prediction: Column, gold: Column) -> Column:
    """Token F1 where two empty answers agree (1) and one empty answer does not (0)."""
    p, g = answer_tokens(prediction), answer_tokens(gold)
    common = multiset_overlap(p, g)
    one_empty = (F.size(p) == 0) | (F.size(g) == 0)
    return F.when(one_empty, (F.size(p) == F.size(g)).cast("double")).when(common == 0, 0.0).otherwise(2.0 * common / (F.size(p) + F.size(g)))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by a space; an array with fewer has none."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def symbol_pairs(symbols: Column) -> Column:
    """Distinct adjacent pairs."""
    pairs = F.when(F.size(symbols) > 1, F.transform(F.sequence(F.lit(1), F.size(symbols) - 1), lambda i: F.concat_ws(" ", F.element_at(symbols, i), F.element_at(symbols, i + 1))))
    return F.array_distinct(F.coalesce(pairs, F.array().cast("array<string>")))


def clean_control(text: Column) -> Column:
    """Control characters, NUL and U+FFFD deleted; white space to spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[\t\n\r\p{Zs}]", " "), r"[\p{Cc}\p{Cf}\x{FFFD}]", "")


#: The eight code-point ranges of Chinese characters.
CHINESE = (("4E00", "9FFF"), ("3400", "4DBF"), ("20000", "2A6DF"), ("2A700", "2B73F"), ("2B740", "2B81F"), ("2B820", "2CEAF"), ("F900", "FAFF"), ("2F800", "2FA1F"))
_CHINESE_CLASS = "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in CHINESE)


def space_chinese(text: Column) -> Column:
    return F.regexp_replace(text, f"([{_CHINESE_CLASS}])", " $1 ")


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks with the letter that remains when their marks are dropped."""
    import unicodedata

    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accents()


def strip_accents(text: Column) -> Column:
    """Latin letters without marks, and combining marks dropped; other scripts' composed letters stay."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{Mn}", "")


#: ASCII marks that are not letters, digits or spaces, and all Unicode punctuation, stand alone.
_MARK = r"[!-/:-@\[-`{-~\p{P}]"


def split_punctuation(text: Column) -> Column:
    """Words with every punctuation mark a token of its own."""
    return F.regexp_extract_all(text, F.lit(rf"({_MARK}|(?:(?!{_MARK})(?U:\S))+)"), F.lit(1))


def basic_tokens(text: Column, lower: bool = True) -> Column:
    """Cleaned, Chinese spaced, lower-cased without accents, split at white space and punctuation."""
    out = space_chinese(clean_control(F.coalesce(text, F.lit(""))))
    return split_punctuation(strip_accents(F.lower(out)) if lower else out)


def normalize_multilingual(text: Column) -> Column:
    """Lower case, bracketed text dropped, marks, symbols and punctuation to spaces, white space collapsed. Without NFKC."""
    out = F.regexp_replace(F.lower(text), r"[<\[][^>\]]*[>\]]", "")
    out = F.lower(F.regexp_replace(F.regexp_replace(out, r"\(([^)]+?)\)", ""), r"[\p{M}\p{S}\p{P}]", " "))
    return F.regexp_replace(out, r"(?U)\s+", " ")


def remove_symbols(text: Column) -> Column:
    """Marks, symbols and punctuation to spaces, diacritics of composed letters kept."""
    return F.regexp_replace(text, r"[\p{M}\p{S}\p{P}]", " ")


#: Letters that no decomposition takes apart.
SPECIAL_LETTERS = {"œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L"}


def remove_symbols_and_diacritics(text: Column, keep: str = "") -> Column:
    """Latin letters without marks; other symbols and punctuation to spaces but for those in keep."""
    kept = "".join("\\" + c for c in keep)
    single = {c: by for c, by in SPECIAL_LETTERS.items() if len(by) == 1}
    folded = F.translate(strip_accents(text), "".join(single), "".join(single.values()))
    for c, by in SPECIAL_LETTERS.items():
        if c not in single:
            folded = F.replace(folded, F.lit(c), F.lit(by))
    return F.regexp_replace(folded, rf"(?![{kept}])[\p{{M}}\p{{S}}\p{{P}}]" if keep else r"[\p{M}\p{S}\p{P}]", " ")


#: English contractions, titles and tenses as they are rewritten, in order.
CONTRACTIONS = (
    (r"\bwon't\b", "will not"),
    (r"\bcan't\b", "can not"),
    (r"\blet's\b", "let us"),
    (r"\bain't\b", "aint"),
    (r"\by'all\b", "you all"),
    (r"\bwanna\b", "want to"),
    (r"\bgotta\b", "got to"),
    (r"\bgonna\b", "going to"),
    (r"\bi'ma\b", "i am going to"),
    (r"\bimma\b", "i am going to"),
    (r"\bwoulda\b", "would have"),
    (r"\bcoulda\b", "could have"),
    (r"\bshoulda\b", "should have"),
    (r"\bma'am\b", "madam"),
    (r"\bmr\b", "mister "),
    (r"\bmrs\b", "missus "),
    (r"\bst\b", "saint "),
    (r"\bdr\b", "doctor "),
    (r"\bprof\b", "professor "),
    (r"\bcapt\b", "captain "),
    (r"\bgov\b", "governor "),
    (r"\bald\b", "alderman "),
    (r"\bgen\b", "general "),
    (r"\bsen\b", "senator "),
    (r"\brep\b", "representative "),
    (r"\bpres\b", "president "),
    (r"\brev\b", "reverend "),
    (r"\bhon\b", "honorable "),
    (r"\basst\b", "assistant "),
    (r"\bassoc\b", "associate "),
    (r"\blt\b", "lieutenant "),
    (r"\bcol\b", "colonel "),
    (r"\bjr\b", "junior "),
    (r"\bsr\b", "senior "),
    (r"\besq\b", "esquire "),
    (r"'d been\b", " had been"),
    (r"'s been\b", " has been"),
    (r"'d gone\b", " had gone"),
    (r"'s gone\b", " has gone"),
    (r"'d done\b", " had done"),
    (r"'s got\b", " has got"),
    (r"n't\b", " not"),
    (r"'re\b", " are"),
    (r"'s\b", " is"),
    (r"'d\b", " would"),
    (r"'ll\b", " will"),
    (r"'t\b", " not"),
    (r"'ve\b", " have"),
    (r"'m\b", " am"),
)
FILLERS = r"\b(hmm|mm|mhm|mmm|uh|um)\b"


def rewrite(text: Column, rules: tuple[tuple[str, str], ...], flags: str = "") -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, flags + pattern, by)
    return text


def substitute_words(words: Column, table: dict[str, str]) -> Column:
    """Words by a table of constants; a word without an entry stays."""
    if not table:
        return words
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(mapping[w], w))


#: Abbreviations before a full stop.
ABBREVIATIONS = (("mrs", "misess"), ("mr", "mister"), ("dr", "doctor"), ("st", "saint"), ("co", "company"), ("jr", "junior"), ("maj", "major"), ("gen", "general"), ("drs", "doctors"), ("rev", "reverend"), ("lt", "lieutenant"), ("hon", "honorable"), ("sgt", "sergeant"), ("capt", "captain"), ("esq", "esquire"), ("ltd", "limited"), ("col", "colonel"), ("ft", "fort"))


def expand_abbreviations(text: Column) -> Column:
    return rewrite(text, tuple((rf"\b{short}\.", long) for short, long in ABBREVIATIONS), "(?i)")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def remove_numbers(lines: Column) -> Column:
    """Digits, underscores and bold marks out of each line, trimmed."""
    return F.transform(lines, lambda x: F.btrim(F.regexp_replace(x, r"\d|_|\*\*", "")))


#: A tag in parentheses, an equation on its line, and a web address.
_TAG, _EQUATION = r"\(([\d.]+[a-zA-Z]?)\)", r"\\\[(.+?)\\\]"
_ADDRESS = r"https?://(?:www\.)?[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b[-a-zA-Z0-9()@:%_+.~#?&/=]*"


def equation_tags(text: Column) -> Column:
    """Lines of an equation with its tag before or behind it, also before one more equation: the tag goes inside."""
    before = F.regexp_replace(text, f"(?m)^{_TAG} {_EQUATION}$", r"\\[$2 \\tag{$1}\\]")
    return F.regexp_replace(before, rf"(?m)^{_EQUATION} {_TAG}( \\\[.+?\\\])?$", r"\\[$1 \\tag{$2}\\]$3")


def link_addresses(text: Column) -> Column:
    return F.regexp_replace(text, f"({_ADDRESS})", "[$1]($1)")


def fence_code(text: Column) -> Column:
    """Fenced parts with each fence on its own line."""
    return F.regexp_replace(text, r"(?s)```\s*(.+?)\s*```", "```\n$1\n```")


def markdown_compatible(text: Column) -> Column:
    """Equation tags inside the equation, bold marks as text, bare URLs as links, algorithms fenced."""
    tagged = F.replace(equation_tags(text), F.lit(r"\. "), F.lit(". "))
    return fence_code(link_addresses(F.replace(tagged, F.lit(r"\mbox{\boldmath$"), F.lit(r"\bm{"))))


def rag_prompt(prefix: str, title: Column, text: Column, question: Column) -> Column:
    """prefix + title / text // question, the title without one pair of quotes, double spaces halved once."""
    bare = F.regexp_replace(F.regexp_replace(title, '^"', ""), '"$', "")
    return F.replace(F.concat(F.lit(prefix), bare, F.lit(" / "), text, F.lit(" // "), question), F.lit("  "), F.lit(" "))


def fill_template(template: str, **columns: Column) -> Column:
    """{name} by its column, anything else as it stands; a null value is empty."""
    import re

    parts = [F.coalesce(columns[p[1:-1]].cast("string"), F.lit("")) if p.startswith("{") and p[1:-1] in columns else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts)


def strip_role_marks(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("user\n\n"), F.lit("")), F.lit("assistant\n\n"), F.lit(""))


def camel_words(identifier: Column) -> Column:
    return F.regexp_extract_all(identifier, F.lit(r"(.+?(?:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|$))"), F.lit(1))


def sublist_starts(items: Column, part: Column) -> Column:
    """0-based places where an array occurs in another."""
    n = F.size(part)
    places = F.when((F.size(items) >= n) & (n > 0), F.sequence(F.lit(0), F.size(items) - n)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.slice(items, i + 1, n) == part)


def char_word_index(text: Column) -> Column:
    """For each character the number of the word it is in or follows; -1 before the first."""
    chars = F.split(text, "")
    seen = F.sequence(F.lit(1), F.length(text))
    start = lambda i: (~F.element_at(chars, i).isin(" ", "\t", "\r", "\n")) & ((i == 1) | F.element_at(chars, F.greatest(i - 1, F.lit(1))).isin(" ", "\t", "\r", "\n"))
    counted = F.aggregate(F.when(F.length(text) > 0, seen).otherwise(F.array().cast("array<int>")), F.array().cast("array<int>"), lambda acc, i: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1)) + start(i).cast("int"))))
    return counted


def table_answer(aggregator: Column, cells: Column) -> Column:
    """Cells joined by commas, with "AGG > " before unless it is NONE."""
    joined = F.array_join(cells, ", ")
    return F.when(F.coalesce(aggregator, F.lit("NONE")) == "NONE", joined).otherwise(F.concat(aggregator, F.lit(" > "), joined))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<.*?>", "")


def adjusted_position(text: Column, position: Column) -> Column:
    """Where a place in tagged text is once the tags before it are gone."""
    return F.length(strip_tags(F.substring(text, F.lit(1), position)))


def json_field(text: Column, name: str) -> Column:
    """A field of a JSON object as text; null where the text is no object or has none of that name."""
    return F.get_json_object(text, f"$.{name}")


def json_keys(text: Column) -> Column:
    """The names of a JSON object's fields in order; null for other texts."""
    return F.json_object_keys(text)
