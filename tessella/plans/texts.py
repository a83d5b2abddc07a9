"""Text, prompt, chat and HTML queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import chat as C
from ..functions import english as E
from ..functions import procedural as P
from ..functions import text as T
from .registry import query, spread, table


def docs(spark, d):
    return spread(table(spark, d, "documents"))


def one(name, sql, fn):
    """A query of one text function over documents."""

    @query(name, None if sql is None else f"SELECT doc_id, {sql} AS out FROM documents")
    def run(spark, d):
        return docs(spark, d).select("doc_id", fn(F.col("text")).alias("out"))

    run.__name__ = run.__qualname__ = name
    return run


one("collapse_whitespace", r"regexp_replace(text, '\s+', ' ', 'g')", T.collapse_whitespace)
one("ascii_only", r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')", T.ascii_only)
one("space_chinese", r"regexp_replace(text, '([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}])', ' \1 ', 'g')", T.space_chinese)
one("clean_control", r"regexp_replace(regexp_replace(text, '[\t\n\r\p{Zs}]', ' ', 'g'), '[\p{Cc}\p{Cf}\x{FFFD}]', '', 'g')", T.clean_control)
one("strip_accents", "strip_accents(text)", T.strip_accents)
one("remove_symbols", r"regexp_replace(text, '[\p{M}\p{S}\p{P}]', ' ', 'g')", T.remove_symbols)
one("normalize_multilingual", r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[<\[][^>\]]*[>\]]', '', 'g'), '\(([^)]+?)\)', '', 'g'), '[\p{M}\p{S}\p{P}]', ' ', 'g'), '\s+', ' ', 'g')", T.normalize_multilingual)
one("split_punctuation", r"len(regexp_extract_all(text, '[!-/:-@\[-`{-~\p{P}]|[^\s!-/:-@\[-`{-~\p{P}]+'))", lambda t: F.size(T.split_punctuation(t)).cast("long"))
one("basic_tokens", r"len(regexp_extract_all(strip_accents(lower(text)), '[!-/:-@\[-`{-~\p{P}]|[^\s!-/:-@\[-`{-~\p{P}]+'))", lambda t: F.size(T.basic_tokens(t)).cast("long"))
one("lower_unicode_words", "array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''), ' ')", lambda t: F.array_join(T.tokens(F.lower(t)), " "))
one("remove_numbers", r"array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\d|_|\*\*', '', 'g'))), chr(10))", lambda t: F.array_join(T.remove_numbers(F.split(t, "\n")), "\n"))
_ABBREVIATED = "text"
for _short, _long in T.ABBREVIATIONS:
    _ABBREVIATED = f"regexp_replace({_ABBREVIATED}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){_short}\\.', '\\1{_long}', 'gi')"
one("expand_abbreviations", _ABBREVIATED, T.expand_abbreviations)
one("strip_tags", "regexp_replace(text, '<.*?>', '', 'g')", T.strip_tags)
one("strip_role_marks", "replace(replace(text, 'user' || chr(10) || chr(10), ''), 'assistant' || chr(10) || chr(10), '')", T.strip_role_marks)
one("markdown_links", r"regexp_replace(text, '(https?://(?:www\.)?[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b[-a-zA-Z0-9()@:%_+.~#?&/=]*)', '[\1](\1)', 'g')", T.markdown_compatible)
one("english_rewrite", None, lambda t: P.string_udf(E.english_normalized)(t))
_PLAIN = "strip_accents(text)"
for _c, _by in T.SPECIAL_LETTERS.items():
    _PLAIN = f"replace({_PLAIN}, '{_c}', '{_by}')"
one("symbols_and_diacritics", rf"regexp_replace({_PLAIN}, '[\p{{M}}\p{{S}}\p{{P}}]', ' ', 'g')", T.remove_symbols_and_diacritics)
one("word_substitution", "array_to_string(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), lambda w: CASE w WHEN 'the' THEN 'THE' WHEN 'of' THEN 'OF' ELSE w END), ' ')", lambda t: F.array_join(T.substitute_words(T.tokens(t), {"the": "THE", "of": "OF"}), " "))
one("truncate_repetitions", None, lambda t: P.string_udf(P.truncate_repetitions)(t))
one("digits_of_words", None, lambda t: P.string_udf(A.digits_of_words)(t))
one("spell_numbers", None, lambda t: P.string_udf(A.spell_numbers)(t))
one("speak_numbers", None, lambda t: P.string_udf(A.speak_numbers)(t))
one("number_rules", None, lambda t: P.string_udf(lambda t: A.number_rules_after(A.number_rules_before(t)))(t))
one("speech_text", None, lambda t: P.string_udf(A.speech_text)(t))
one("drop_repeated_references", None, lambda t: P.string_udf(P.drop_repeated_references)(t))
one("normalize_lists", None, lambda t: P.string_udf(P.normalize_lists)(t))
one("correct_tables", None, lambda t: P.string_udf(P.correct_tables)(t))
one("clean_document", None, lambda t: P.string_udf(P.clean_document)(t))


@query("camel_words", r"SELECT event_id, array_to_string(list_filter([regexp_extract(x, '^(.+?)([A-Z].*)?$', 1), regexp_extract(x, '^[^A-Z]*([A-Z].*)$', 1)], lambda w: w <> ''), ' ') AS out FROM (SELECT event_id, event_type || 'Kind' AS x FROM events)")
def camel_words(spark, d):
    x = F.concat("event_type", F.lit("Kind"))
    return table(spark, d, "events").select("event_id", F.array_join(T.camel_words(x), " ").alias("out"))


@query("char_word_index", r"SELECT item_id, list_transform(range(1, length(text) + 1), lambda i: len(regexp_extract_all(text[1:i], '[^ \t\r\n]+')) - 1) AS words FROM benchmark")
def char_word_index(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.char_word_index(F.col("text")).cast("array<bigint>").alias("words"))


@query("sublist_search", "SELECT item_id, list_transform(list_filter(range(1, len(w)), lambda i: w[i] = w[1]), lambda i: i - 1) AS places FROM (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark)")
def sublist_search(spark, d):
    w = T.tokens(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.filter(T.sublist_starts(w, F.slice(w, 1, 1)), lambda i: i < F.size(w) - 1).cast("array<bigint>").alias("places"))


@query("answer_span_improvement", "SELECT item_id, list_min(list_filter(range(0, len(w)), lambda i: w[i + 1] = w[len(w)])) AS start FROM (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark)")
def answer_span_improvement(spark, d):
    """The first smallest span that equals the tokenized answer (here the text's last word)."""
    w = T.tokens(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.array_min(T.sublist_starts(w, F.slice(w, -1, 1))).cast("bigint").alias("start"))


@query("table_answer", "SELECT user_id, CASE WHEN count(*) > 60 THEN 'COUNT > ' ELSE '' END || array_to_string(list_sort(list(DISTINCT event_type)), ', ') AS answer FROM events GROUP BY 1")
def table_answer(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("event_type")).alias("c"))
    return g.select("user_id", T.table_answer(F.when(F.col("n") > 60, "COUNT").otherwise("NONE"), F.col("c")).alias("answer"))


@query("tagged_positions", "SELECT doc_id, length(regexp_replace('<b>x</b><i>' || text, '<.*?>', '', 'g')) AS n, length(regexp_replace(substring('<b>x</b><i>' || text, 1, 11), '<.*?>', '', 'g')) AS start FROM documents")
def tagged_positions(spark, d):
    tagged = F.concat(F.lit("<b>x</b><i>"), "text")
    return docs(spark, d).select("doc_id", F.length(T.strip_tags(tagged)).cast("long").alias("n"), T.adjusted_position(tagged, F.lit(11)).cast("long").alias("start"))


@query("tagged_phrases", "SELECT doc_id, regexp_extract_all('<phrase>' || source || '</phrase><object>' || lang || '</object>', '<phrase>([^<]+)</phrase>', 1) AS phrases FROM documents")
def tagged_phrases(spark, d):
    tagged = F.concat(F.lit("<phrase>"), "source", F.lit("</phrase><object>"), "lang", F.lit("</object>"))
    return docs(spark, d).select("doc_id", F.regexp_extract_all(tagged, F.lit("<phrase>([^<]+)</phrase>"), F.lit(1)).alias("phrases"))


@query("rag_prompt", """SELECT doc_id, replace('ask: ' || regexp_replace(regexp_replace('"' || source || '"', '^"', ''), '"$', '') || ' / ' || text || ' // ' || lang, '  ', ' ') AS prompt FROM documents""")
def rag_prompt(spark, d):
    return docs(spark, d).select("doc_id", T.rag_prompt("ask: ", F.concat(F.lit('"'), "source", F.lit('"')), F.col("text"), F.col("lang")).alias("prompt"))


@query("prompt_template", "SELECT item_id, 'Question: ' || text || chr(10) || 'Reasoning: ' || item_id || chr(10) || 'Answer:' AS prompt FROM benchmark")
def prompt_template(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.fill_template("Question: {question}\nReasoning: {reasoning}\nAnswer:", question=F.col("text"), reasoning=F.col("item_id")).alias("prompt"))


@query("instruction_suffix", "SELECT item_id, text || ' Answer with as few words as possible.' AS prompt FROM benchmark")
def instruction_suffix(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.concat("text", F.lit(" Answer with as few words as possible.")).alias("prompt"))


def chats(spark, d):
    return C.conversations(table(spark, d, "conversations"))


@query("chat_concat", "SELECT conv_id, string_agg(text || '<|endoftext|>', '' ORDER BY turn) AS prompt FROM conversations GROUP BY 1")
def chat_concat(spark, d):
    return chats(spark, d).select("conv_id", C.render_concatenated(F.col("messages")).alias("prompt"))


_B = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(
    "chat_inst",
    f"""WITH m AS (SELECT conv_id, turn, role, text, first_value(role) OVER w AS r0, first_value(text) OVER w AS t0, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, n - 1 - CASE WHEN r0 = 'system' THEN 1 ELSE 0 END AS i FROM m WHERE NOT (r0 = 'system' AND n = 1)),
c AS (SELECT *, CASE WHEN i = 0 AND r0 = 'system' THEN '<<SYS>>' || chr(10) || t0 || chr(10) || '<</SYS>>' || chr(10) || chr(10) || text ELSE text END AS content FROM b),
r AS (SELECT conv_id, i, (role = 'user') = (i % 2 = 0) AS ok, CASE role WHEN 'user' THEN '<s>[INST] ' || {_B.format('content')} || ' [/INST]' WHEN 'system' THEN '<<SYS>>' || chr(10) || {_B.format('content')} || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE ' ' || {_B.format('content')} || ' </s>' END AS s FROM c)
SELECT a.conv_id, CASE WHEN coalesce(ok, true) THEN coalesce(prompt, '') END AS prompt FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN (SELECT conv_id, bool_and(ok) AS ok, string_agg(s, '' ORDER BY i) AS prompt FROM r GROUP BY 1) USING (conv_id)""",
)
def chat_inst(spark, d):
    return chats(spark, d).select("conv_id", C.render_instructions(F.col("messages")).alias("prompt"))


@query("role_alternation", "SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role IN ('user', 'assistant', 'system')) WHERE NOT (role = 'user' AND coalesce(p = 'user', false))")
def role_alternation(spark, d):
    return C.valid_messages(table(spark, d, "conversations")).select("conv_id", "turn", "role")


@query("chat_views", "WITH g AS (SELECT conv_id, coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'user'), []) AS u, coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'assistant'), []) AS a, arg_max(role, turn) AS last FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN last = 'user' THEN u[1 : len(u) - 1] ELSE u END AS past_user_inputs, a AS generated_responses FROM g")
def chat_views(spark, d):
    return chats(spark, d).select("conv_id", C.views(F.col("messages")).alias("v")).select("conv_id", "v.*")


@query("html_nodes")
def html_nodes(spark, d):
    return spread(table(spark, d, "pages")).select("page_id", F.posexplode(P.html_nodes_udf()("html")).alias("pos", "n")).select("page_id", "pos", "n.node", "n.xpath")


@query("wordpiece")
def wordpiece(spark, d):
    letters = [c for c in "abcdefghijklmnopqrstuvwxyz"]
    vocabulary = letters + ["##" + c for c in letters] + ["the", "##er", "##tion", "##th", "an", "##and", "##ing"]
    return docs(spark, d).select("doc_id", P.wordpiece_udf(vocabulary)(T.basic_tokens(F.col("text"))).alias("p")).select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", " ")).alias("digest"))


@query("byte_bpe")
def byte_bpe(spark, d):
    ranks = {p: i for i, p in enumerate([("t", "h"), ("th", "e"), ("i", "n"), ("e", "r"), ("a", "n"), ("o", "n"), ("in", "g"), ("an", "d")])}
    return docs(spark, d).select("doc_id", P.byte_bpe_udf(ranks)(T.tokens(F.col("text"))).alias("p")).select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", " ")).alias("digest"))


@query("near_dup_lines")
def near_dup_lines(spark, d):
    """Adjacent lines that are equal or differ in fewer than a tenth of their characters."""
    from pyspark.sql import Window

    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("i"))
    a, b = F.col("line"), F.col("before")
    near = (a == b) | (F.length(a).between(4, 199) & F.length(b).between(4, 199) & (F.levenshtein(a, b) * 2 < 0.1 * (F.length(a) + F.length(b))))
    return lines.withColumn("before", before).where(near).select("doc_id", "i")


_SEGMENTS = r"""ln AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(ls[i]) <> ''),
nw AS (SELECT doc_id, i, line, len(list_filter(string_split_regex(line, '\s+'), lambda w: w <> '')) AS n FROM ln),
pl AS (SELECT *, (sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n) // 128 AS seg FROM nw),
wh AS (SELECT doc_id, seg, string_agg(line, ' ' ORDER BY i) AS segment FROM pl GROUP BY 1, 2),
sg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS seg_no, segment FROM wh),
nx AS (SELECT *, lead(segment) OVER (PARTITION BY doc_id ORDER BY seg_no) AS next, CAST('0x' || substring(md5('0-' || doc_id || '-' || seg_no), 1, 8) AS BIGINT) % 2 = 1 AS coin FROM sg)"""


@query("order_pairs", f"WITH {_SEGMENTS} SELECT doc_id, CAST(seg_no AS INT) AS seg_no, CASE WHEN coin THEN next ELSE segment END AS first, CASE WHEN coin THEN segment ELSE next END AS second, coin AS swapped FROM nx WHERE next IS NOT NULL")
def order_pairs(spark, d):
    from ..operators.pairs import order_pairs as pairs

    return pairs(docs(spark, d))


@query(
    "next_pairs",
    f"""WITH {_SEGMENTS}, nr AS (SELECT *, row_number() OVER (ORDER BY doc_id, seg_no) - 1 AS row, next IS NULL OR coin AS random FROM nx),
dr AS (SELECT *, CASE WHEN random THEN CAST('0x' || substring(md5('1-' || doc_id || '-' || seg_no), 1, 8) AS BIGINT) % (SELECT count(*) FROM nr) END AS other FROM nr)
SELECT a.doc_id, CAST(a.seg_no AS INT) AS seg_no, a.segment AS first, CASE WHEN a.random THEN b.segment ELSE a.next END AS second, a.random FROM dr a LEFT JOIN dr b ON a.other = b.row WHERE NOT a.random OR b.doc_id <> a.doc_id""",
)
def next_pairs(spark, d):
    from ..operators.pairs import next_pairs as pairs

    return pairs(docs(spark, d))


@query("byte_letters", "SELECT CAST(b AS INT) AS byte, CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 THEN chr(CAST(b AS INT)) ELSE chr(CAST(255 + count(*) FILTER (WHERE NOT (b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255)) OVER (ORDER BY b) AS INT)) END AS letter FROM range(0, 256) t(b)")
def byte_letters(spark, d):
    return spark.createDataFrame(sorted(P.byte_letters().items()), "byte INT, letter STRING")
