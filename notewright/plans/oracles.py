"""The same results in plain SQL, for checking the queries on another engine.

Each statement is written from the definition of its operator over the raw tables. It
shares nothing with the DataFrame code but the word lists and prompt layouts.
"""

from __future__ import annotations

import re
import string

from notewright import schema as S
from notewright import templates as T
from notewright.plans.queries import BROAD, BUDGET, CUES, EXAMPLES, NAMES, RELABEL, SECTION_LABELS, SYMPTOMS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strs(values) -> str:
    return ", ".join(lit(v) for v in values)


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def rstrip(c: str) -> str:
    return rf"regexp_replace({c}, '\s+$', '')"


def norm(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


def n_words(c: str) -> str:
    return f"len({words(c)})"


DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
BENCH = "bench AS (SELECT item_id AS id, text FROM benchmark)"
DIALOGUES = """dialogues AS (
  SELECT conv_id AS id, string_agg('[' || role || ']: ' || text, chr(10) ORDER BY turn) AS dialogue
  FROM conversations GROUP BY conv_id)"""
PAIRS = """pairs AS (
  SELECT conv_id AS id, string_agg('[' || role || ']: ' || text, chr(10) ORDER BY turn) AS dialogue,
    coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS ref,
    coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS pred
  FROM conversations GROUP BY conv_id)"""
PLACE = "('0x' || substr(md5(phrase), 1, 12))::BIGINT"
LEXICON = f"""lexicon AS (
  SELECT ord, phrase, ([{strs(S.ENTITY_LABELS)}])[(ord % 10 + 1)::INT] AS label,
    least(1.0::DOUBLE, round(0.3::DOUBLE + (ord % 8)::DOUBLE / 10, 4)) AS score
  FROM (SELECT phrase, {PLACE} AS ord
        FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS phrase FROM benchmark)))"""
CONCEPTS = f"""concepts AS (
  SELECT phrase, {PLACE} AS ord, upper(phrase) AS term
  FROM (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase
        FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)))"""


LONG_PHRASES = f"""long_phrases AS (
  SELECT phrase, ([{strs(S.ENTITY_LABELS)}])[(ord % 10 + 1)::INT] AS label, least(1.0::DOUBLE, round(0.3::DOUBLE + (ord % 8)::DOUBLE / 10, 4)) AS score
  FROM (SELECT phrase, {PLACE} AS ord FROM (
    SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), (VALUES (1), (2), (3)) AS t(n)))))"""


def pieces(name: str, src: str, col: str) -> str:
    """Words of a text column with their character places."""
    return f"""{name}_p AS (
  SELECT id, unnest(a) AS piece, generate_subscripts(a, 1) AS i
  FROM (SELECT id, regexp_extract_all({col}, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS a FROM {src})),
{name}_w AS (
  SELECT id, lower(piece) AS word, e - length(piece) AS s, e,
    row_number() OVER (PARTITION BY id ORDER BY e) - 1 AS wpos
  FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY id ORDER BY i) AS e FROM {name}_p)
  WHERE regexp_matches(piece, '^[A-Za-z0-9]'))"""


def tagged(name: str, src: str, col: str) -> str:
    return f"""{pieces(name, src, col)},
{name} AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY s, e, label) - 1 AS pos, phrase AS text, label,
    score, false AS negated, s::BIGINT AS start, e::BIGINT AS "end"
  FROM {name}_w JOIN lexicon ON word = phrase)"""


def negated(out: str, ents: str, name: str) -> str:
    """Entities of ``ents`` with scopes from the word table of ``name``."""
    return f"""{out}_scopes AS (
  SELECT id, s, (SELECT max(b.e) FROM {name}_w b WHERE b.id = a.id
      AND b.wpos BETWEEN a.wpos AND a.wpos + {S.NEGATION_SCOPE_WORDS}) AS e
  FROM {name}_w a WHERE word IN ({strs(CUES)})),
{out} AS (
  SELECT id, pos, text, label, score, EXISTS (SELECT 1 FROM {out}_scopes s
      WHERE s.id = t.id AND s.e > t.start AND s.s < t."end") AS negated, start, "end"
  FROM {ents} t)"""


DOC_ENTS = f"{DOCS},\n{LEXICON},\n{tagged('ents', 'docs', 'text')}"
NOISY = f"""{DOC_ENTS},
noisy AS (
  SELECT id, pos,
    CASE pos % 4 WHEN 1 THEN 'The my ' || text WHEN 2 THEN upper(text)
      WHEN 3 THEN 'i’ve been having ' || text || ' ' ELSE text END AS text,
    CASE label WHEN 'follow-up instruction' THEN 'Follow-Up' WHEN 'test or lab order' THEN ' lab '
      WHEN 'drug detail' THEN 'dosage' WHEN 'physical exam finding' THEN 'exam finding'
      WHEN 'referral' THEN 'somewhere else' ELSE label END AS label,
    CASE WHEN pos % 6 <> 5 THEN score * 1.25::DOUBLE END AS score
  FROM ents)"""
SYNONYM_CASE = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in S.LABEL_SYNONYMS.items())


def canonical(src: str) -> str:
    return f"""canon AS (
  SELECT id, pos, {strip('text')} AS text,
    CASE lower({strip('label')}) {SYNONYM_CASE} ELSE lower({strip('label')}) END AS label,
    round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(score, 0.8::DOUBLE))), 4) AS score
  FROM {src}),
canonical AS (
  SELECT * FROM canon WHERE label IN ({strs(S.ENTITY_LABELS)}) AND length(text) > 1
    AND {n_words('text')} <= 7)"""


FILLER = r"(?i)^(?:(?:" + "|".join(p.replace("'", "''") for p in S.FILLER_PHRASES) + r")\s*)+"


def cleaned(src: str) -> str:
    return f"""straight AS (
  SELECT * REPLACE (replace(replace({strip('text')}, '’', ''''), '‘', '''') AS text) FROM {src}),
peeled AS (
  SELECT * REPLACE ({strip(f"regexp_replace(text, '{FILLER}', '')")} AS text)
  FROM straight WHERE {n_words('text')} <= 7),
cleaned AS (SELECT * FROM peeled WHERE length(text) > 1)"""


LABEL_CELLS = """label_cells AS (
  SELECT doc_id AS id, '[{"text": "quality ' || quality || '", "label": "diagnosis"}]' AS entities_json
  FROM labels)"""
COMBINED = f"""{DOCS},\n{PAIRS},\n{LABEL_CELLS},
combined AS (
  SELECT docs.id, docs.text, entities_json, pred AS retrieved_note
  FROM docs LEFT JOIN label_cells USING (id) LEFT JOIN pairs USING (id))"""
BLANK = r"coalesce(regexp_replace({c}, '\s+', '', 'g'), '') = ''"


def blank(c: str) -> str:
    return BLANK.format(c=c)


# ------------------------------------------------------------------ sections


def header(i: int, name: str) -> str:
    return rf"\*{{0,2}}\s*(?:{i}[.\):]?\s*)?{name}\s*:?\s*\*{{0,2}}"


def has_header(note: str, i: int, name: str) -> str:
    return f"regexp_matches({note}, '(?i){header(i, name)}')"


def sections(name: str, src: str, note: str, names, keys: str = "id") -> str:
    """``{name}_h``: headers with places; ``{name}``: keys, section, body (loose layout)."""
    hits = "\n  UNION ALL ".join(
        rf"""SELECT {keys}, {i} AS k, {note} AS note,
    length(regexp_extract({note}, '(?s)^(.*?)(?i:{header(i, n)})', 1)) AS b,
    length(regexp_extract({note}, '(?i){header(i, n)}')) AS w
  FROM {src} WHERE {has_header(note, i, n)}"""
        for i, n in enumerate(names, 1)
    )
    all_names = ", ".join(f"({i}, {lit(n)})" for i, n in enumerate(names, 1))
    return f"""{name}_h AS (
  {hits}),
{name}_b AS (
  SELECT {keys}, k, b, {strip('substr(note, b + w + 1, greatest(coalesce(nb, length(note)) - b - w, 0))')} AS body
  FROM (SELECT *, lead(b) OVER (PARTITION BY {keys} ORDER BY b + w) AS nb FROM {name}_h)),
{name}_n(k, section) AS (VALUES {all_names}),
{name} AS (
  SELECT {', '.join('r.' + c for c in keys.split(', '))}, n.section, n.k, coalesce(s.body, '') AS body
  FROM {src} r CROSS JOIN {name}_n n LEFT JOIN {name}_b s
    ON n.k = s.k AND {' AND '.join(f'r.{c} = s.{c}' for c in keys.split(', '))})"""


def flags(note: str, names) -> str:
    parts = [f"{has_header(note, i, n)} AS {lit(n.lower()).replace(chr(39), chr(34))}" for i, n in enumerate(names, 1)]
    every = " AND ".join(has_header(note, i, n) for i, n in enumerate(names, 1))
    return ", ".join([*parts, f"({every}) AS all_headers"])


# ------------------------------------------------------------------- prompts


def fill(template: str, **slots: str) -> str:
    parts = re.split(r"\{(" + "|".join(slots) + r")\}", template) if slots else [template]
    return " || ".join(f"coalesce({slots[p]}, '')" if i % 2 else lit(p) for i, p in enumerate(parts) if p)


BLOCK_CASE = " ".join(
    f"WHEN {lit(lab)} THEN {k}" for k, labs in enumerate(S.SECTION_LABELS.values()) for lab in labs
)


def block(name: str, rows: str, ents: str) -> str:
    return f"""{name}_d AS (
  SELECT id, sec, min(pos) AS pos, arg_min(text, pos) AS text
  FROM (SELECT id, pos, text, CASE lower(label) {BLOCK_CASE} END AS sec FROM {ents})
  WHERE sec IS NOT NULL GROUP BY id, sec, lower(text)),
{name}_l AS (
  SELECT id, sec, ([{strs(S.SECTIONS)}])[sec + 1] || ': ' || string_agg(text, ', ' ORDER BY pos) AS line
  FROM {name}_d GROUP BY id, sec),
{name} AS (
  SELECT r.id, coalesce(string_agg(line, chr(10) ORDER BY sec), {lit(S.NO_ENTITIES)}) AS entity_block
  FROM {rows} r LEFT JOIN {name}_l l ON r.id = l.id GROUP BY r.id)"""


def prompts_sql() -> str:
    dlg, note, ent = "dialogue", "note", "entity_block"
    d = {"dialogue": strip(dlg)}
    dn = {**d, "note": strip(note)}
    e = {"entities": ent, "dialogue": dlg}

    def few(listed) -> str:
        some = any(listed)
        out = [lit((T.FEWSHOT_ENTITY_INSTRUCTION if some else "[INST] " + T.NOTE_INSTRUCTION) + T.FEWSHOT_HEAD)]
        for k, on in enumerate(listed, 1):
            out.append(lit(f"=== Example {k} ===\n"))
            if on:
                out.append(fill(T.FEWSHOT_ENTITIES, entities=f"x{k}.entity_block"))
            out.append(fill(T.FEWSHOT_DIALOGUE, dialogue=f"x{k}.dialogue"))
            out.append(fill(T.FEWSHOT_NOTE, note=f"x{k}.note"))
        out.append(lit(T.FEWSHOT_CASE if some else T.FEWSHOT_TASK))
        if some:
            out.append(fill(T.FEWSHOT_ENTITIES, entities="r.entity_block"))
        out += [fill(T.FEWSHOT_DIALOGUE, dialogue="r.dialogue"), lit(T.FEWSHOT_END)]
        return " || ".join(out)

    judge = " || ".join([fill(T.JUDGE_NOTE, note="generated_note"), lit(T.JUDGE_TAIL)])
    plain = {
        "dialogue_infer": fill(T.DIALOGUE_INFER, **d),
        "dialogue_train": fill(T.DIALOGUE_TRAIN, **dn),
        "dialogue_train_end": fill(T.DIALOGUE_TRAIN + "</s>", **dn),
        "entity_infer": fill(T.ENTITIES_INFER, **e),
        "entity_train": fill(T.ENTITIES_TRAIN, note=note, **e),
        "ablation": fill(T.ENTITIES_INFER, entities=lit(S.NO_ENTITIES), dialogue=dlg),
        "optional_train": " || ".join(
            [
                lit(T.OPTIONAL_HEAD),
                f"CASE WHEN {blank(ent)} THEN '' ELSE {fill(T.OPTIONAL_BLOCK, entities=ent)} END",
                fill(T.OPTIONAL_TAIL, dialogue=dlg),
                strip(note),
                lit("</s>"),
            ]
        ),
        "extraction": lit("[INST] " + T.EXTRACTION_RULES)
        + " || "
        + fill(T.EXTRACTION_TAIL, dialogue="substr(dialogue, 1, 6000)"),
        "judge": fill(T.JUDGE_HEAD, dialogue=dlg) + " || " + judge,
        "judge_gold": fill(T.JUDGE_HEAD, dialogue=dlg)
        + f" || CASE WHEN note <> '' THEN {fill(T.JUDGE_GOLD, gold=note)} ELSE '' END || "
        + judge,
        "input_output": fill(T.INPUT_OUTPUT, prompt=f"({fill(T.DIALOGUE_INFER, **d)})", target=note),
    }
    shots = {"fewshot_entities": (True, True), "fewshot_mixed": (True, False), "fewshot_dialogue": (False, False)}
    selects = [f"SELECT id, {lit(k)} AS layout, {v} AS prompt FROM rows_" for k, v in plain.items()]
    selects += [
        f"SELECT r.id, {lit(k)} AS layout, {few(v)} AS prompt FROM rows_ r, "
        f"(SELECT * FROM rows_ WHERE id = {EXAMPLES[0]}) x1, (SELECT * FROM rows_ WHERE id = {EXAMPLES[1]}) x2"
        for k, v in shots.items()
    ]
    return f"""WITH {PAIRS},\n{LEXICON},\n{tagged('ents', 'dialogues_', 'dialogue').replace('dialogues_', 'pairs')},
{block('blocks', 'pairs', 'ents')},
rows_ AS (SELECT id, dialogue, ref AS note, pred AS generated_note, entity_block FROM pairs JOIN blocks USING (id))
""" + "\nUNION ALL ".join(selects)


# ------------------------------------------------------------------ retrieval


def bm25_terms(name: str, docs: str) -> str:
    """Words of each document, lengths, and the weight of each word."""
    toks = words("lower(text)")
    return f"""{name}_tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({toks}) AS term FROM {docs}) GROUP BY ALL),
{name}_len AS (SELECT id, len({toks}) AS dl FROM {docs}),
{name}_n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_len),
{name}_raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw
  FROM {name}_tf, {name}_n GROUP BY term, n),
{name}_idf AS (SELECT term, df, CASE WHEN raw < 0 THEN round(0.25::DOUBLE * (SELECT avg(raw) FROM {name}_raw), 10)
  ELSE raw END AS idf FROM {name}_raw)"""


def bm25(name: str, queries: str, docs: str, k: int = 20, where: str = "") -> str:
    """Okapi scores straight from the formula, over every pair that shares a word."""
    toks = words("lower(text)")
    return f"""{bm25_terms(name, docs)},
{name}_q AS (SELECT id AS query_id, term, count(*) AS qtf FROM (SELECT id, unnest({toks}) AS term FROM {queries}) GROUP BY ALL),
{name}_s AS (
  SELECT query_id, t.id, round(sum(qtf * idf * tf * 2.5::DOUBLE
      / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM {name}_q q JOIN {name}_idf i USING (term) JOIN {name}_tf t USING (term)
    JOIN {name}_len l ON l.id = t.id, {name}_n {where} GROUP BY query_id, t.id),
{name} AS (
  SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score
    FROM {name}_s) WHERE rank <= {k})"""


VECS = "vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


def vector(name: str, queries: str, corpus: str, k: int = 20, where: str = "") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score
    FROM (SELECT q.id AS query_id, c.id, round(list_inner_product(q.v, c.v), 6) AS score
          FROM {queries} q, {corpus} c {where}))
  WHERE rank <= {k})"""


def fused(name: str, words_: str, vecs_: str, k: int) -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT query_id, row_number() OVER (PARTITION BY query_id
        ORDER BY raw DESC, b ASC NULLS LAST, v ASC NULLS LAST, id) AS rank, id,
      coalesce(b, -1)::BIGINT AS bm25_rank, coalesce(v, -1)::BIGINT AS vec_rank, round(raw, 6) AS rrf_score
    FROM (SELECT query_id, id, b.rank AS b, v.rank AS v,
        coalesce(1.0::DOUBLE / (b.rank + 60), 0) + coalesce(1.0::DOUBLE / (v.rank + 60), 0) AS raw
      FROM {words_} b FULL JOIN {vecs_} v USING (query_id, id)))
  WHERE rank <= {k})"""


def hybrid(other_only: bool = False, k: int = 2) -> str:
    bw = "WHERE query_id <> t.id" if other_only else ""
    vw = "WHERE q.id <> c.id" if other_only else ""
    return f"""{DOCS},\n{VECS},
dvecs AS (SELECT vecs.* FROM vecs JOIN docs USING (id)),
{bm25('bw', 'docs', 'docs', 20, bw)},
{vector('vw', 'dvecs', 'dvecs', 20, vw)},
{fused('hits', 'bw', 'vw', k)}"""


NEAREST = """near AS (
  SELECT query_id, coalesce(arg_min(id, rank) FILTER (id <> query_id), arg_min(id, rank)) AS id,
    coalesce(min(rank) FILTER (id <> query_id) > min(rank), false) AS self_skipped,
    count(*) FILTER (id <> query_id) = 0 AS fallback
  FROM hits GROUP BY query_id)"""


# ---------------------------------------------------------------- text scores


def toks13a(c: str) -> str:
    out = c
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = f"replace({out}, {lit(old)}, {lit(new)})"
    for pat, rep in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        out = f"regexp_replace({out}, {lit(pat)}, {lit(rep)}, 'g')"
    return words(out)


def toks_rouge(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def grams(name: str, src: str, tok, orders, keys: str = "id") -> str:
    """``{name}``: keys, n, hit, pred, ref summed per pair and order."""
    per = "\n  UNION ALL ".join(
        f"SELECT {keys}, {n} AS n, array_to_string(t[i:i + {n - 1}], ' ') AS gram, p, 1 - p AS r "
        f"FROM (SELECT *, unnest(range(1, len(t) - {n} + 2)) AS i FROM {name}_t)"
        for n in orders
    )
    return f"""{name}_t AS (
  SELECT {keys}, {tok('pred')} AS t, 1 AS p FROM {src} UNION ALL SELECT {keys}, {tok('ref')}, 0 FROM {src}),
{name}_g AS (
  {per}),
{name} AS (
  SELECT {keys}, n, sum(least(a, b)) AS hit, sum(a) AS pred, sum(b) AS ref
  FROM (SELECT {keys}, n, gram, sum(p) AS a, sum(r) AS b FROM {name}_g GROUP BY ALL) GROUP BY {keys}, n)"""


def bleu_expr() -> str:
    def h(f, n):
        return f"coalesce(sum({f}) FILTER (n = {n}), 0)::DOUBLE"

    ok = " AND ".join(f"{h('hit', n)} > 0" for n in (1, 2, 3, 4))
    logs = " + ".join(f"ln({h('hit', n)} / {h('pred', n)})" for n in (1, 2, 3, 4))
    penalty = f"CASE WHEN {h('pred', 1)} <= {h('ref', 1)} THEN exp(1 - {h('ref', 1)} / {h('pred', 1)}) ELSE 1.0::DOUBLE END"
    return f"round(CASE WHEN {ok} THEN {penalty} * exp(({logs}) / 4) ELSE 0 END, 6)"


def rouge_rows(name: str, src: str, keys: str = "id") -> str:
    def f(n):
        return (
            f"coalesce(max(CASE WHEN hit > 0 THEN 2.0::DOUBLE * hit / (c.pred + c.ref) ELSE 0 END) "
            f"FILTER (n = {n}), 0) AS rouge{n}"
        )

    using = f"USING ({keys})"
    return f"""{grams(name + '_c', src, toks_rouge, (1, 2), keys)},
{name} AS (SELECT {keys}, {f(1)}, {f(2)} FROM {src} LEFT JOIN {name}_c c {using} GROUP BY {keys})"""


def length_cols() -> str:
    p, r = n_words("pred"), n_words("ref")
    return f"""round(coalesce(avg({p}), 0), 1) AS avg_pred_length, round(coalesce(avg({r}), 0), 1) AS avg_ref_length,
  round(count(*) FILTER ({r} > 0 AND {p} > 2 * {r})::DOUBLE / greatest(count(*), 1), 4) AS over_2x_ratio"""


RUNS = f"""{PAIRS},
runs AS (
  SELECT 'assistant' AS config, id, ref, pred FROM pairs UNION ALL SELECT 'user', id, ref, ref FROM pairs
  UNION ALL SELECT 'dialogue', id, ref, dialogue FROM pairs)"""

SWEEP = f"""{RUNS},
{grams('g', 'runs', toks13a, (1, 2, 3, 4), 'config, id')},
{rouge_rows('rg', 'runs', 'config, id')},
sweep AS (
  SELECT config, n_pairs, bleu, rouge1, rouge2, avg_pred_length, avg_ref_length, over_2x_ratio,
    avg_pred_chars, avg_ref_chars, round(100.0::DOUBLE * n_pairs / (SELECT count(*) FROM pairs), 4) AS coverage
  FROM (SELECT config, count(*) AS n_pairs, {length_cols()},
          round(avg(length(pred)), 4) AS avg_pred_chars, round(avg(length(ref)), 4) AS avg_ref_chars
        FROM runs GROUP BY config)
  JOIN (SELECT config, {bleu_expr()} AS bleu FROM g GROUP BY config) USING (config)
  JOIN (SELECT config, round(avg(rouge1), 6) AS rouge1, round(avg(rouge2), 6) AS rouge2 FROM rg GROUP BY config) USING (config))"""
SWEEP_METRICS = (
    "n_pairs", "bleu", "rouge1", "rouge2", "avg_pred_length", "avg_ref_length", "over_2x_ratio",
    "avg_pred_chars", "avg_ref_chars", "coverage",
)

# -------------------------------------------------------------- entity scores

PAIR_ENTS = f"{PAIRS},\n{LEXICON},\n{tagged('pe', 'pairs', 'pred')},\n{tagged('re', 'pairs', 'ref')}"
DLG_ENTS = f"{PAIRS},\n{LEXICON},\n{tagged('de', 'pairs', 'dialogue')}"


def ent_norm(c: str) -> str:
    return norm(f"translate({c}, {lit(string.punctuation)}, '')")


def diff() -> str:
    def side(src):
        return f"SELECT DISTINCT id, label, {ent_norm('text')} AS text FROM {src} WHERE NOT negated AND {ent_norm('text')} <> ''"

    return f"""diff AS (
  SELECT id, label, text, (p IS NOT NULL AND g IS NOT NULL)::BIGINT AS tp,
    (g IS NULL)::BIGINT AS fp, (p IS NULL)::BIGINT AS fn
  FROM (SELECT *, 1 AS p FROM ({side('pe')})) FULL JOIN (SELECT *, 1 AS g FROM ({side('re')})) USING (id, label, text))"""


def prf(group: str) -> str:
    cols = f"{group}, " if group else ""
    return f"""SELECT {cols}round(p, 4) AS precision, round(r, 4) AS recall,
  round(2 * p * r / greatest(p + r, 1e-12::DOUBLE), 4) AS f1, tp, fp, fn
FROM (SELECT {cols}tp, fp, fn, tp::DOUBLE / greatest(tp + fp, 1) AS p, tp::DOUBLE / greatest(tp + fn, 1) AS r
  FROM (SELECT {cols}coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp,
          coalesce(sum(fn), 0)::BIGINT AS fn FROM diff {'GROUP BY ' + group if group else ''}))"""


GROUNDING = f"""ground AS (
  SELECT p.id, count(*) AS n, count(*) FILTER (k.text IS NULL) AS bad
  FROM pe p LEFT JOIN (SELECT DISTINCT id, {norm('text')} AS text FROM re) k
    ON k.id = p.id AND k.text = {norm('p.text')}
  GROUP BY p.id)"""

RECALL = f"""recall_ AS (
  SELECT count(*) AS n_symptoms, count(*) FILTER (contains({norm('p.pred')}, {norm('e.text')})) AS n_covered
  FROM {{ents}} e JOIN pairs p USING (id) WHERE label IN ({strs(SYMPTOMS)}) AND NOT negated)"""


# --------------------------------------------------------------- verification


def verify() -> str:
    home = " ".join(f"WHEN {lit(lab)} THEN {lit(sec)}" for sec, labs in SECTION_LABELS.items() for lab in labs)
    return f"""{PAIR_ENTS},
{negated('said', 're', 're')},
notes AS (SELECT id, pred AS note FROM pairs),
{sections('sec', 'notes', 'note', NAMES)},
faith AS (SELECT p.id, 1.0::DOUBLE - count(*) FILTER (NOT EXISTS (SELECT 1 FROM said s
    WHERE s.id = p.id AND {norm('s.text')} = {norm('p.text')}))::DOUBLE / count(*) AS x FROM pe p GROUP BY p.id),
neg AS (SELECT id, avg((NOT EXISTS (SELECT 1 FROM pe p WHERE p.id = s.id AND NOT p.negated
    AND {norm('p.text')} = s.text))::INT) AS x
  FROM (SELECT DISTINCT id, {norm('text')} AS text FROM said WHERE negated) s GROUP BY id),
comp AS (SELECT s.id, avg(contains({norm('note')}, s.text)::INT) AS x
  FROM (SELECT DISTINCT id, {norm('text')} AS text FROM said) s JOIN notes USING (id) GROUP BY s.id),
cons AS (SELECT s.id, count(*) FILTER (h.b IS NOT NULL AND s.body <> ''
    AND h.b >= coalesce((SELECT max(o.b) FROM sec_h o WHERE o.id = s.id AND o.k < s.k), -1))::DOUBLE / 4 AS x
  FROM sec s LEFT JOIN sec_h h ON h.id = s.id AND h.k = s.k GROUP BY s.id),
appr AS (SELECT p.id, avg(coalesce(contains({norm('s.body')}, {norm('p.text')}), false)::INT) AS x
  FROM (SELECT *, CASE lower(label) {home} END AS home FROM pe) p
  LEFT JOIN sec s ON s.id = p.id AND s.section = p.home GROUP BY p.id),
scores AS (
  SELECT n.id, coalesce(faith.x, 1) AS a, coalesce(neg.x, 1) AS b, coalesce(comp.x, 1) AS c, cons.x AS d, coalesce(appr.x, 1) AS e
  FROM notes n LEFT JOIN faith ON faith.id = n.id LEFT JOIN neg ON neg.id = n.id
    LEFT JOIN comp ON comp.id = n.id LEFT JOIN cons ON cons.id = n.id LEFT JOIN appr ON appr.id = n.id),
verified AS (
  SELECT id, round(a, 6) AS faithfulness, round(b, 6) AS negation, round(c, 6) AS completeness, round(d, 6) AS consistency,
    round(e, 6) AS appropriateness, round((a + b + c + d + e) / 5, 6) AS overall_score,
    round((a + b + c + d + e) / 5, 6) >= 0.6 AS passed
  FROM scores),
missing AS (
  SELECT DISTINCT m.id, m.home, m.text
  FROM (SELECT id, CASE lower(label) {home} END AS home, {norm('text')} AS text FROM said WHERE NOT negated) m
  JOIN verified v ON v.id = m.id AND NOT v.passed JOIN notes n ON n.id = m.id
  WHERE home IS NOT NULL AND NOT contains({norm('note')}, m.text)),
added AS (SELECT id, home, string_agg(text, ', ' ORDER BY text) AS txt FROM missing GROUP BY id, home),
rebuilt AS (
  SELECT s.id, string_agg('**' || k || '. ' || section || ':**' || chr(10)
      || concat_ws(chr(10), nullif(body, ''), txt), chr(10) || chr(10) ORDER BY k) AS note
  FROM sec s LEFT JOIN added a ON a.id = s.id AND a.home = s.section GROUP BY s.id),
corrected AS (
  SELECT n.id, CASE WHEN passed THEN n.note ELSE r.note END AS generated_note,
    (SELECT count(*) FROM missing m WHERE m.id = n.id) AS corrections_applied
  FROM notes n JOIN verified v ON v.id = n.id JOIN rebuilt r ON r.id = n.id)"""


# ------------------------------------------------------------------ statements


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    roles = "user|assistant|system"
    turns = rf"""{DIALOGUES},
turns AS (
  SELECT id, unnest(a) AS text, generate_subscripts(a, 1) - 1 AS turn FROM (
    SELECT id, list_filter(list_transform(string_split(
      regexp_replace(dialogue, '(?i)(\[(?:{roles})\]:)', chr(1) || '\1', 'g'), chr(1)),
      lambda t: {strip('t')}), lambda t: t <> '') AS a FROM dialogues))"""
    q["assemble_dialogues"] = f"WITH {DIALOGUES} SELECT * FROM dialogues"
    q["split_turns"] = f"WITH {turns} SELECT id, turn, text FROM turns"
    q["chunk_turns"] = f"""WITH RECURSIVE {turns},
t AS (SELECT id, turn, text, {n_words('text')} AS n FROM turns),
r AS (
  SELECT id, turn, n AS cur, 0 AS chunk FROM t WHERE turn = 0
  UNION ALL
  SELECT t.id, t.turn, CASE WHEN cur + n > 200 THEN n ELSE cur + n END, CASE WHEN cur + n > 200 THEN chunk + 1 ELSE chunk END
  FROM r JOIN t ON t.id = r.id AND t.turn = r.turn + 1),
c AS (SELECT id, chunk, string_agg(text, ' ' ORDER BY turn) AS text FROM r JOIN t USING (id, turn) GROUP BY id, chunk)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY chunk) - 1 AS chunk, text FROM c WHERE length({strip('text')}) >= 5"""
    q["chunk_fixed"] = f"""WITH {turns} SELECT id, (turn // 3)::BIGINT AS chunk, string_agg(text, ' ' ORDER BY turn) AS text
FROM turns GROUP BY id, turn // 3"""
    q["split_85_15"] = "SELECT doc_id AS id, CASE WHEN doc_id * 37 % 100 < 85 THEN 'train' ELSE 'eval' END AS split FROM documents"
    q["first_n"] = "SELECT doc_id AS id, text FROM documents ORDER BY doc_id LIMIT 100"
    q["lookup_ids"] = f"""WITH {DOCS}, {LABEL_CELLS} SELECT id, text, coalesce(entities_json, '[]') AS entities_json
FROM docs LEFT JOIN label_cells USING (id) WHERE id IN (1, 3747)"""
    q["resume_antijoin"] = "SELECT doc_id AS id, length(text) AS n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
    q["tokenize"] = f"SELECT token, count(*) AS n FROM (SELECT unnest({words('lower(text)')}) AS token FROM documents) GROUP BY token"
    q["truncate_chars"] = "SELECT doc_id AS id, substr(text, 1, 2000) AS text FROM documents"
    q["normalize_text"] = f"SELECT doc_id AS id, {norm('text')} AS plain, {ent_norm('text')} AS bare FROM documents"
    q["split_sections"] = f"WITH {DOCS}, {sections('sec', 'docs', 'text', NAMES)} SELECT id, section, body FROM sec"
    q["compose_note"] = f"""WITH {PAIRS} SELECT id, '**1. Subjective:**' || chr(10) || ref || chr(10) || chr(10) || '**2. Objective:**' || chr(10)
|| pred || chr(10) || chr(10) || '**3. Assessment:**' || chr(10) || dialogue || chr(10) || chr(10) || '**4. Plan:**' || chr(10) AS note FROM pairs"""
    q["split_sections_strict"] = f"""WITH {PAIRS}
SELECT id, 'Subjective' AS section, {strip('ref')} AS body FROM pairs UNION ALL SELECT id, 'Objective', {strip('pred')} FROM pairs
UNION ALL SELECT id, 'Assessment', {strip('dialogue')} FROM pairs UNION ALL SELECT id, 'Plan', '' FROM pairs"""
    q["section_flags"] = f"SELECT doc_id AS id, {flags('text', NAMES)} FROM documents"

    def last(c, needle):
        n = lit(needle)
        return f"(CASE WHEN contains({c}, {n}) THEN length({c}) - strpos(reverse({c}), reverse({n})) - {len(needle)} + 1 ELSE -1 END)"

    q["smart_truncate"] = f"""WITH {DOCS}, {PAIRS},
m AS (SELECT floor(median(length(ref)))::BIGINT AS t FROM pairs),
a AS (SELECT id, text, t, substr(text, 1, t) AS cut FROM docs, m),
b AS (SELECT id, text, t, CASE WHEN {last('cut', '#####')} > t * 0.5 THEN {rstrip(f"substr(cut, 1, {last('cut', '#####')})")} ELSE cut END AS cut FROM a),
c AS (SELECT *, {last('cut', chr(10) + chr(10))} AS para, greatest({last('cut', '. ')}, {last('cut', '.' + chr(10))}) AS sent FROM b)
SELECT id, CASE WHEN length(text) <= t THEN text WHEN para > length(cut) * 0.7 THEN {rstrip('substr(cut, 1, para)')}
  WHEN sent > length(cut) * 0.7 THEN {rstrip('substr(cut, 1, sent + 1)')} ELSE {rstrip('cut')} END AS text FROM c"""

    # entities
    ent_cols = 'id, pos, text, label, score, negated, start, "end"'
    q["tag_lexicon"] = f"WITH {DOC_ENTS} SELECT {ent_cols} FROM ents"
    q["tag_words"] = f"WITH {DOC_ENTS} SELECT id, wpos AS pos, word AS text, label, score FROM ents_w JOIN lexicon ON word = phrase"
    q["tag_longest"] = f"""WITH RECURSIVE {DOCS}, {LONG_PHRASES}, {pieces('d', 'docs', 'text')},
      runs AS (
        SELECT id, wpos, s, e, word AS phrase, 1 AS n FROM d_w
        UNION ALL SELECT a.id, a.wpos, a.s, b.e, a.word || ' ' || b.word, 2 FROM d_w a JOIN d_w b ON a.id = b.id AND b.wpos = a.wpos + 1
        UNION ALL SELECT a.id, a.wpos, a.s, c.e, a.word || ' ' || b.word || ' ' || c.word, 3
          FROM d_w a JOIN d_w b ON a.id = b.id AND b.wpos = a.wpos + 1 JOIN d_w c ON a.id = c.id AND c.wpos = a.wpos + 2),
      longest AS (SELECT id, wpos, arg_max((s, e, phrase, label, score, n), n) AS h FROM runs JOIN long_phrases USING (phrase) GROUP BY id, wpos),
      nexts AS (SELECT id, wpos, h, wpos + h[6] AS free FROM longest),
      linked AS (SELECT x.id, x.wpos, x.h, y.wpos AS next FROM nexts x ASOF LEFT JOIN (SELECT id, wpos FROM longest) y ON x.id = y.id AND x.free <= y.wpos),
      chosen AS (
        SELECT id, wpos, h, next FROM linked WHERE (id, wpos) IN (SELECT (id, min(wpos)) FROM linked GROUP BY id)
        UNION ALL SELECT l.id, l.wpos, l.h, l.next FROM chosen c JOIN linked l ON l.id = c.id AND l.wpos = c.next)
      SELECT id, row_number() OVER (PARTITION BY id ORDER BY wpos) - 1 AS pos, h[3] AS text, h[4] AS label, h[5] AS score, false AS negated,
        h[1]::BIGINT AS start, h[2]::BIGINT AS "end" FROM chosen"""
    q["parse_entities_object"] = f"""WITH {NOISY}
      SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, text, label, score FROM noisy"""
    batch = "CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 0 ELSE 1 END"
    q["resume_ledger"] = f"SELECT doc_id AS id, length(text) AS n_chars, 'run-' || {batch} AS batch FROM documents WHERE length(text) > 1000"
    q["ledger_commits"] = f"""SELECT 'run-' || n AS batch, n::BIGINT AS nth, count(doc_id) AS n_keys, count(*) FILTER (length(text) > 1000) AS n_rows
      FROM (SELECT {batch} AS n, doc_id, text FROM documents UNION ALL SELECT 2, NULL, NULL) GROUP BY n"""
    q["parse_entities"] = f"""WITH {NOISY},
cells AS (SELECT id, '[' || string_agg('{{"text":' || to_json(text) || ',"label":' || to_json(label)
    || coalesce(',"score":' || score, '') || '}}', ',' ORDER BY pos) || ']' AS body FROM noisy GROUP BY id),
resp AS (SELECT id, CASE id % 6 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```'
    WHEN 1 THEN 'Here they are: ' || body || ' Done.' WHEN 2 THEN '[3, "x", {{"text": "y"}}, ' || substr(body, 2)
    WHEN 3 THEN '{{"entities": ' || body || '}}' WHEN 4 THEN substr(body, 1, length(body) - 1) ELSE body END AS r FROM cells),
txt AS (SELECT id, trim(replace(replace(r, '```json', ''), '```', ''), ' ' || chr(10)) AS t FROM resp),
two AS (SELECT id, t, regexp_extract(t, '(?s)\\[.*\\]') AS sl FROM txt),
arr AS (SELECT id, CASE WHEN json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t END) = 'ARRAY' THEN t
    WHEN json_valid(sl) AND json_type(CASE WHEN json_valid(sl) THEN sl END) = 'ARRAY' THEN sl END AS j FROM two),
items AS (SELECT id, unnest(l) AS item, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT id, json_extract(j, '$[*]') AS l FROM arr WHERE j IS NOT NULL))
SELECT id, pos, item ->> '$.text' AS text, item ->> '$.label' AS label, try_cast(item ->> '$.score' AS DOUBLE) AS score
FROM items WHERE json_type(item) = 'OBJECT' AND item ->> '$.text' IS NOT NULL AND item ->> '$.label' IS NOT NULL""".replace("\\\\", "\\")
    q["canonical_label"] = f"WITH {NOISY}, {canonical('noisy')} SELECT id, pos, text, label, score FROM canonical"
    q["clean_spans"] = f"WITH {NOISY}, {cleaned('noisy')} SELECT id, pos, text FROM cleaned"
    q["dedup_entities"] = f"""WITH {NOISY}, {canonical('noisy')}, {cleaned('canonical')},
uniq AS (SELECT id, min(pos) AS pos, arg_min(text, (-score, pos)) AS text, arg_min(label, (-score, pos)) AS label,
  max(score) AS score FROM cleaned GROUP BY id, lower({strip('text')})),
kept AS (SELECT * FROM uniq u WHERE NOT EXISTS (SELECT 1 FROM uniq o WHERE o.id = u.id AND o.label = u.label
  AND length(o.text) > length(u.text) AND contains(lower(o.text), lower(u.text))))
SELECT id, pos, text, label, score, row_number() OVER (PARTITION BY id ORDER BY length(text) DESC, pos) AS dup_rank FROM kept"""
    q["adaptive_threshold"] = f"""WITH {NOISY}, {canonical('noisy')},
n AS (SELECT *, count(*) FILTER (score >= 0.9) OVER (PARTITION BY id) AS sure FROM canonical)
SELECT id, pos, text, label, score FROM n WHERE score >= CASE WHEN sure < 5 THEN 0.5 ELSE 0.9 END"""
    dx = " OR ".join(f"contains(text, {lit(k)})" for k in RELABEL["diagnosis_keywords"])
    fu = " OR ".join(f"contains(text, {lit(k)})" for k in RELABEL["follow_up_keywords"])
    q["relabel_broad"] = f"""WITH {DOC_ENTS}, b AS (SELECT id, pos, text, ([{strs(BROAD)}])[(start % 5 + 1)::INT] AS broad FROM ents)
SELECT id, pos, text, CASE broad WHEN 'subjective finding' THEN CASE WHEN {dx} THEN 'diagnosis' ELSE 'symptom' END
  WHEN 'objective finding' THEN CASE WHEN regexp_matches(text, {lit(RELABEL['vital_pattern'])}) THEN 'vital sign'
    WHEN {dx} THEN 'diagnosis' ELSE 'physical exam finding' END
  WHEN 'treatment' THEN CASE WHEN regexp_matches(text, {lit(RELABEL['doctor_pattern'])})
    OR regexp_matches(text, {lit(RELABEL['specialist_pattern'])}) THEN 'referral'
    WHEN regexp_matches(text, {lit(RELABEL['dosage_pattern'])}) THEN 'drug detail'
    WHEN {fu} THEN 'follow-up instruction' ELSE 'medication' END
  WHEN 'test' THEN 'test or lab order' ELSE broad END AS label FROM b"""

    def promote(extra=""):
        return f"""WITH {DOC_ENTS},
best AS (SELECT id, arg_min(text, (-score, pos)) AS text FROM ents WHERE label = 'symptom' GROUP BY id),
spot AS (SELECT e.id, min(e.pos) AS pos FROM ents e JOIN best b ON b.id = e.id AND b.text = e.text WHERE label = 'symptom' {extra} GROUP BY e.id)
SELECT e.id, e.pos, e.text, CASE WHEN s.id IS NOT NULL THEN 'chief complaint' ELSE label END AS label
FROM ents e LEFT JOIN spot s ON s.id = e.id AND s.pos = e.pos"""

    q["promote_chief"] = promote()
    q["promote_chief_if_absent"] = promote("AND e.id NOT IN (SELECT id FROM ents WHERE label = 'chief complaint')")
    q["mark_negated"] = f"WITH {DOC_ENTS}, {negated('marked', 'ents', 'ents')} SELECT {ent_cols} FROM marked"
    q["normalize_concept"] = f"""WITH {DOC_ENTS}, {CONCEPTS},
terms AS (SELECT t.text, coalesce(arg_min(term, ord) FILTER (s.phrase = t.text), arg_min(term, ord), t.text) AS term
  FROM (SELECT DISTINCT text FROM ents) t LEFT JOIN concepts s ON contains(t.text, s.phrase) OR contains(s.phrase, t.text) GROUP BY t.text)
SELECT id, pos, text, term, NULL::VARCHAR AS cui FROM ents JOIN terms USING (text)"""
    q["entity_block"] = f"WITH {DOC_ENTS}, {block('blocks', 'docs', 'ents')} SELECT id, entity_block FROM blocks"
    flat = " ".join(f"WHEN {lit(lab)} THEN {k}" for k, (_, lab) in enumerate(S.FLAT_HEADINGS))
    q["entity_block_flat"] = f"""WITH {DOC_ENTS},
lines AS (SELECT id, h, '- ' || ([{strs(h for h, _ in S.FLAT_HEADINGS)}])[h + 1] || ': ' || string_agg(text, ', ' ORDER BY pos) AS line
  FROM (SELECT id, pos, text, CASE label {flat} END AS h FROM ents) WHERE h IS NOT NULL GROUP BY id, h)
SELECT d.id, coalesce(string_agg(line, chr(10) ORDER BY h), {lit(S.NO_ENTITIES_FLAT)}) AS entity_block
FROM docs d LEFT JOIN lines l ON l.id = d.id GROUP BY d.id"""
    q["entity_set_diff"] = f"WITH {PAIR_ENTS}, {diff()} SELECT id, label, text, tp, fp, fn FROM diff"
    q["render_prompts"] = prompts_sql()
    spoken = words("dialogue")
    q["fit_budget"] = f"""WITH {PAIRS},
a AS (SELECT id, dialogue, {fill(T.DIALOGUE_INFER, dialogue='dialogue')} AS prompt, len({spoken}) AS n FROM pairs),
b AS (SELECT *, {n_words('prompt')} - {BUDGET} AS over, greatest(0, n - ({n_words('prompt')} - {BUDGET}) - 50) AS keep FROM a),
c AS (SELECT id, over, n, keep, CASE WHEN over <= 0 THEN prompt ELSE
  {fill(T.DIALOGUE_INFER, dialogue=f"array_to_string(({spoken})[1:keep], ' ')")} END AS prompt FROM b)
SELECT id, prompt, {n_words('prompt')} AS n_tokens, CASE WHEN over <= 0 THEN n ELSE keep END AS n_kept FROM c"""

    # gates and joins
    bad = f"({blank('entities_json')} OR {blank('retrieved_note')})"
    q["drop_blank"] = f"WITH {COMBINED} SELECT id FROM combined WHERE NOT {bad}"
    q["skip_counts"] = f"WITH {COMBINED} SELECT count(*) AS n_rows, count(*) FILTER {bad} AS n_skipped FROM combined"
    q["gate_counts"] = f"""WITH {COMBINED}
SELECT count(*) AS n_rows, 'entities_json' AS column_name, count(*) FILTER ({blank('entities_json')}) AS n_missing FROM combined
UNION ALL SELECT count(*), 'retrieved_note', count(*) FILTER ({blank('retrieved_note')}) FROM combined"""
    q["pair_up"] = f"WITH {DOCS}, {PAIRS} SELECT id, pred, text AS ref FROM pairs JOIN docs USING (id)"
    q["coverage"] = """WITH n AS (SELECT d.doc_id AS id, count(l.doc_id) AS k FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT count(*) AS n_gold, sum(k)::BIGINT AS n_matched, count(*) FILTER (k = 0) AS n_missing,
  round(100.0::DOUBLE * sum(k) / count(*), 4) AS coverage FROM n"""
    q["missing_ids"] = "SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels"
    q["merge_reconciled"] = f"""WITH {DOCS}, {PAIRS}, {LABEL_CELLS}
SELECT id, text AS dialogue, text AS note, entities_json, pred AS retrieved_note FROM docs JOIN label_cells USING (id) JOIN pairs USING (id)"""
    q["merge_report"] = f"""WITH {DOCS}, {PAIRS}, {LABEL_CELLS}, a AS (SELECT id FROM docs JOIN label_cells USING (id)),
n AS (SELECT (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM pairs) AS y, (SELECT count(*) FROM a JOIN pairs USING (id)) AS z)
SELECT x AS n_annotated, y AS n_retrieved, z AS n_merged, (z <> x OR z <> y) AS rows_lost FROM n"""
    q["lookup_left"] = f"""WITH {DOCS}, last AS (SELECT conv_id AS id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id)
SELECT docs.id, coalesce(last.text, '') AS text FROM docs LEFT JOIN last ON last.id = docs.id"""
    q["resolve_inputs"] = f"""WITH {DOCS}, {PAIRS}, {LABEL_CELLS},
own AS (SELECT id, CASE id % 3 WHEN 0 THEN pred WHEN 1 THEN ' ' END AS note, CASE WHEN id % 2 = 1 THEN '[]' END AS ents FROM pairs)
SELECT own.id, CASE WHEN NOT {blank('own.note')} THEN own.note ELSE coalesce(docs.text, '') END AS retrieved_note,
  CASE WHEN NOT {blank('own.ents')} THEN own.ents ELSE coalesce(label_cells.entities_json, '{{}}') END AS entities_json
FROM own LEFT JOIN docs ON docs.id = own.id LEFT JOIN label_cells ON label_cells.id = own.id"""

    # retrieval
    hit_cols = "query_id, rank, id, score"
    q["bm25_idf"] = f"WITH {DOCS}, {bm25_terms('bw', 'docs')} SELECT term, df, round(idf, 6) AS idf FROM bw_idf"
    q["bm25_topk"] = f"WITH {DOCS}, {BENCH}, {bm25('bw', 'bench', 'docs')} SELECT {hit_cols} FROM bw"
    q["bm25_topk_dialogues"] = f"""WITH {DOCS}, {DIALOGUES}, said AS (SELECT id, dialogue AS text FROM dialogues),
{bm25('bw', 'said', 'docs')} SELECT {hit_cols} FROM bw"""
    q["vector_topk"] = f"WITH {VECS}, {vector('vw', 'vecs', 'vecs')} SELECT {hit_cols} FROM vw"
    q["rrf_fuse"] = f"""WITH {DOCS}, {BENCH}, {VECS}, asked AS (SELECT * FROM vecs WHERE id IN (SELECT id FROM bench)),
{bm25('bw', 'bench', 'docs')}, {vector('vw', 'asked', 'vecs')}, {fused('hits', 'bw', 'vw', 10)}
SELECT query_id, rank, id, bm25_rank, vec_rank, rrf_score FROM hits"""
    q["hybrid_topk"] = f"""WITH {hybrid()} SELECT hits.*, substr(docs.text, 1, 2000) AS dialogue, docs.text AS note
FROM hits JOIN docs ON docs.id = hits.id"""
    q["nearest_other"] = f"WITH {hybrid()}, {NEAREST} SELECT query_id, id, self_skipped, fallback FROM near"
    q["nearest_others"] = f"""WITH {hybrid(k=6)}
      SELECT query_id, nth AS rank, id FROM (
        SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM hits WHERE id <> query_id)
      WHERE nth <= 4"""
    q["nearest_other_early"] = f"WITH {hybrid(True)}, {NEAREST} SELECT query_id, id, self_skipped, fallback FROM near"
    q["raft_report"] = f"""WITH {hybrid()}, {NEAREST} SELECT count(*) AS n_rows, count(*) FILTER (self_skipped) AS n_self_skipped,
  count(*) FILTER (fallback) AS n_fallback, round(avg(length(text)), 4) AS avg_note_chars FROM near JOIN docs USING (id)"""

    # text scores
    q["bleu"] = f"""WITH {PAIRS}, {grams('g', 'pairs', toks13a, (1, 2, 3, 4))}
SELECT (SELECT count(*) FROM pairs) AS n_pairs, {bleu_expr()} AS bleu,
  round((sum(pred) FILTER (n = 1))::DOUBLE / sum(ref) FILTER (n = 1), 6) AS length_ratio,
  (sum(pred) FILTER (n = 1))::BIGINT AS pred_len, (sum(ref) FILTER (n = 1))::BIGINT AS ref_len FROM g"""
    q["rouge_n"] = f"""WITH {PAIRS}, {rouge_rows('rg', 'pairs')}
SELECT count(*) AS n_pairs, round(avg(rouge1), 6) AS rouge1, round(avg(rouge2), 6) AS rouge2 FROM rg"""
    q["length_stats"] = f"WITH {PAIRS} SELECT {length_cols()} FROM pairs"

    # entity scores
    q["entity_prf"] = f"WITH {PAIR_ENTS}, {diff()} {prf('')}"
    q["entity_prf_all"] = f"WITH {PAIR_ENTS}, {diff()} {prf('label')} UNION ALL SELECT NULL, * FROM ({prf('')})"
    q["quality_gates"] = f"""WITH {DLG_ENTS},
      d AS (SELECT de.id, count(*) AS n, avg(contains(lower(ref), lower(text))::INT) AS useful,
        avg((lower(text) IN (SELECT phrase FROM lexicon WHERE label = 'symptom'))::INT) AS noise, count(*) FILTER ({n_words('text')} > 7) AS long,
        min(score) AS lo, max(score) AS hi FROM de JOIN pairs USING (id) GROUP BY de.id),
      m AS (SELECT round(coalesce(avg(useful), 0), 6) AS u, round(coalesce(avg(noise), 0), 6) AS x, coalesce(sum(long), 0)::DOUBLE AS l,
        (min(lo) = max(hi))::INT::DOUBLE AS same FROM d)
      SELECT 0::BIGINT AS gate, 'usefulness_mean' AS metric, u::DOUBLE AS value, '>=' AS test, 0.7::DOUBLE AS bound, CASE WHEN u >= 0.7 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m
      UNION ALL SELECT 1, 'noise_mean', x, '<', 0.1, CASE WHEN x < 0.1 THEN 'PASS' ELSE 'FAIL' END FROM m
      UNION ALL SELECT 2, 'spans_over_7_words', l, '<=', 0, CASE WHEN l <= 0 THEN 'PASS' ELSE 'WARN' END FROM m
      UNION ALL SELECT 3, 'all_scores_identical', same, '<=', 0, CASE WHEN same <= 0 THEN 'PASS' ELSE 'WARN' END FROM m"""
    q["entity_prf_by_label"] = f"WITH {PAIR_ENTS}, {diff()} {prf('label')}"
    q["usefulness"] = f"""WITH {DLG_ENTS}, s AS (SELECT id, avg(contains(lower(ref), lower(text))::INT) AS x FROM de JOIN pairs USING (id) GROUP BY id)
SELECT round(coalesce(avg(x), 0), 6) AS mean, round(coalesce(median(x), 0), 6) AS median, round(coalesce(stddev_samp(x), 0), 6) AS std FROM s"""
    q["noise_ratio"] = f"""WITH {DOC_ENTS}, r AS (SELECT id, avg((lower(text) IN (SELECT phrase FROM lexicon WHERE label = 'symptom'))::INT) AS x FROM ents GROUP BY id)
SELECT round(coalesce(avg(x), 0), 6) AS mean FROM r"""
    q["keyword_coverage"] = f"""WITH {PAIR_ENTS}, kw AS (SELECT phrase AS w FROM lexicon),
wanted AS (SELECT id, w, EXISTS (SELECT 1 FROM pe WHERE pe.id = pairs.id AND (contains(pe.text, w) OR contains(w, pe.text))) AS hit
  FROM pairs JOIN kw ON contains(lower(ref), w)), s AS (SELECT id, avg(hit::INT) AS x FROM wanted GROUP BY id)
SELECT round(coalesce(avg(x), 0), 6) AS mean, count(*) AS rows_evaluated FROM s"""
    rate = "round(n_covered::DOUBLE / greatest(n_symptoms, 1), 4) AS symptom_recall"
    q["symptom_recall"] = f"WITH {DLG_ENTS}, {RECALL.format(ents='de')} SELECT n_symptoms, n_covered, {rate} FROM recall_"
    hallucinated = """SELECT coalesce(sum(n), 0)::BIGINT AS n_generated, coalesce(sum(bad), 0)::BIGINT AS n_hallucinated,
  round(coalesce(sum(bad), 0)::DOUBLE / greatest(coalesce(sum(n), 0), 1), 4) AS hallucination_rate FROM ground"""
    q["hallucination_rate"] = f"WITH {PAIR_ENTS}, {GROUNDING} {hallucinated}"
    q["label_distribution"] = f"""WITH {DOC_ENTS} SELECT label, count(*) AS n,
  round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM ents), 4) AS pct FROM ents GROUP BY label"""
    spans = (("words_1", "n = 1"), ("words_2", "n = 2"), ("words_3_4", "n BETWEEN 3 AND 4"), ("words_5_7", "n BETWEEN 5 AND 7"), ("words_over_7", "n > 7"))
    q["span_lengths"] = f"""WITH {NOISY}, s AS (SELECT {n_words('text')} AS n FROM noisy)
SELECT round(avg(n), 2) AS mean, median(n) AS median, min(n) AS min, max(n) AS max, count(*) AS total_spans,
  {', '.join(f'count(*) FILTER ({c}) AS {k}' for k, c in spans)},
  {', '.join(f'round(100.0::DOUBLE * count(*) FILTER ({c}) / count(*), 1) AS {k}_pct' for k, c in spans)} FROM s"""
    q["confidence_stats"] = f"""WITH {DOC_ENTS} SELECT round(avg(score), 4) AS mean, round(median(score), 4) AS median, round(min(score), 4) AS min,
  round(max(score), 4) AS max, count(DISTINCT round(score, 4)) AS n_distinct, count(DISTINCT round(score, 4)) = 1 AS all_identical,
  count(*) FILTER (score < 0.3) AS below_03, count(*) FILTER (score >= 0.3 AND score < 0.5) AS from_03_to_05,
  count(*) FILTER (score >= 0.5 AND score < 0.7) AS from_05_to_07, count(*) FILTER (score >= 0.7 AND score < 0.9) AS from_07_to_09,
  count(*) FILTER (score >= 0.9) AS from_09 FROM ents"""
    q["split_summary"] = f"""WITH {DOC_ENTS}, s AS (SELECT d.id, count(e.id) AS n, min(score) AS lo, max(score) AS hi FROM docs d LEFT JOIN ents e ON e.id = d.id GROUP BY d.id)
SELECT count(*) AS n_rows, round(avg(n), 4) AS avg_entities, round(coalesce(avg(lo), 0), 4) AS avg_min_score,
  round(coalesce(avg(hi), 0), 4) AS avg_max_score FROM s"""
    q["combined_stats"] = f"""WITH {DLG_ENTS}, s AS (SELECT p.id, any_value(pred) AS note, count(e.id) AS n FROM pairs p LEFT JOIN de e ON e.id = p.id GROUP BY p.id)
SELECT count(*) AS n_rows, round(avg(n), 4) AS avg_entities, round(avg(length(note)), 4) AS avg_retrieved_chars FROM s"""

    # reports
    def percents(note):
        cols = [*((n.lower(), has_header(note, i, n)) for i, n in enumerate(NAMES, 1))]
        cols.append(("all_headers", " AND ".join(c for _, c in cols)))
        return ", ".join(f"round(100.0::DOUBLE * count(*) FILTER ({c}) / greatest(count(*), 1), 2) AS pct_{n}" for n, c in cols)

    q["structure_report"] = f"SELECT count(*) AS n_notes, {percents('text')} FROM documents"
    q["corpus_profile"] = f"""WITH {PAIRS}, l AS (SELECT 'dialogue' AS column_name, dialogue AS t FROM pairs UNION ALL SELECT 'ref', ref FROM pairs
  UNION ALL SELECT 'pred', pred FROM pairs)
SELECT column_name, count(*) AS n_rows, round(avg(length(t)), 4) AS mean_chars, median(length(t)) AS median_chars,
  round(quantile_cont(length(t), 0.95), 4) AS p95_chars, round(avg({n_words('t')}), 4) AS mean_words,
  round(avg(len(list_filter(string_split_regex(t, '[.!?\\n]'), lambda s: regexp_matches(s, '[A-Za-z0-9]')))), 4) AS mean_sentences
FROM l GROUP BY column_name""".replace("\\\\", "\\")
    q["sweep_report"] = f"WITH {SWEEP} SELECT * FROM sweep"
    long = " UNION ALL ".join(f"SELECT config, {lit(m)} AS metric, {m}::DOUBLE AS value FROM sweep" for m in SWEEP_METRICS)
    q["compare_runs"] = f"""WITH {SWEEP}, long AS ({long})
SELECT metric, b.value AS before, a.value AS after, round(a.value - b.value, 6) AS delta
FROM (SELECT * FROM long WHERE config = 'dialogue') b JOIN (SELECT * FROM long WHERE config = 'assistant') a USING (metric)"""
    q["leaderboard"] = f"""WITH {SWEEP} SELECT rank() OVER (ORDER BY bleu DESC) AS place, config, bleu,
  round(bleu - (SELECT bleu FROM sweep WHERE config = 'dialogue'), 6) AS delta FROM sweep"""
    present = " + ".join(f"{has_header('c.pred', i, n)}::INT" for i, n in enumerate(NAMES, 1))
    cands = f"""{RUNS},\n{LEXICON},\n{tagged('re', 'pairs', 'ref')},
med AS (SELECT median(length(ref)) AS m FROM pairs),
wanted AS (SELECT DISTINCT id, {norm('text')} AS text FROM re),
part AS (SELECT c.config, c.id, c.pred, ({present})::DOUBLE / 4 AS hs,
  greatest(0.0::DOUBLE, 1 - abs(length(c.pred) - m) / greatest(m, 1.0::DOUBLE)) AS ls,
  coalesce((SELECT avg(contains({norm('c.pred')}, w.text)::INT) FROM wanted w WHERE w.id = c.id), 1) AS er FROM runs c, med),
cand AS (SELECT config, id, pred, round(er, 6) AS entity_recall, round(hs, 6) AS header_share, round(ls, 6) AS length_score,
  round((er + hs + ls) / 3, 6) AS score FROM part)"""
    q["candidate_scores"] = f"WITH {cands} SELECT config, id, entity_recall, header_share, length_score, score FROM cand"
    q["best_of_n"] = f"""WITH {cands} SELECT id, config, score, pred AS generated_note
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, config) AS rn FROM cand) WHERE rn = 1"""

    def rows_of(select: str, names) -> str:
        return " UNION ALL ".join(f"SELECT {lit(alias)} AS metric, {c}::DOUBLE AS value FROM ({select})" for c, alias in names)

    same = [(c, c) for c in ("avg_pred_length", "avg_ref_length", "over_2x_ratio")]
    heads = [(f"pct_{n.lower()}", f"pct_{n.lower()}") for n in NAMES] + [("pct_all_headers", "pct_all_headers"), ("n_notes", "n_notes")]
    q["full_report_relational"] = f"""WITH {PAIR_ENTS}, {diff()}, {GROUNDING}, {RECALL.format(ents='re')},
np AS (SELECT id, {norm('pred')} AS pred, {norm('ref')} AS ref FROM pairs),
{grams('g', 'np', toks13a, (1, 2, 3, 4))}, {rouge_rows('rg', 'np')}
""" + " UNION ALL ".join(
        [
            f"SELECT 'bleu' AS metric, {bleu_expr()}::DOUBLE AS value FROM g",
            "SELECT 'rouge1', round(avg(rouge1), 6) FROM rg",
            "SELECT 'rouge2', round(avg(rouge2), 6) FROM rg",
            rows_of(f"SELECT {length_cols()} FROM pairs", same),
            rows_of(f"SELECT count(*) AS n_notes, {percents('pred')} FROM pairs", heads),
            rows_of(
                prf(""),
                [(c, f"entity_{c}") for c in ("precision", "recall", "f1")] + [(c, c) for c in ("tp", "fp", "fn")],
            ),
            *(
                f"SELECT '{name}[' || label || ']', {c}::DOUBLE FROM ({prf('label')})"
                for c, name in [*((c, f"entity_{c}") for c in ("precision", "recall", "f1")), *((c, c) for c in ("tp", "fp", "fn"))]
            ),
            rows_of(hallucinated, [("hallucination_rate", "hallucination_rate")]),
            rows_of(f"SELECT {rate} FROM recall_", [("symptom_recall", "symptom_recall")]),
        ]
    )

    # verification
    q["verify_notes"] = f"WITH {verify()} SELECT * FROM verified"
    q["apply_correction"] = f"WITH {verify()} SELECT id, generated_note, corrections_applied FROM corrected"
    dims = ("faithfulness", "negation", "completeness", "consistency", "appropriateness")
    q["verification_report"] = f"""WITH {verify()} SELECT count(*) AS n_notes, count(*) FILTER (passed) AS n_passed,
  count(*) FILTER (NOT passed) AS n_failed, round(100.0::DOUBLE * count(*) FILTER (passed) / greatest(count(*), 1), 4) AS pct_passed,
  round(avg(overall_score), 4) AS mean_overall, {', '.join(f'round(avg({d}), 4) AS mean_{d}' for d in dims)},
  sum(corrections_applied)::BIGINT AS n_corrections FROM verified JOIN corrected USING (id)"""
    return q
