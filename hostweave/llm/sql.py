"""DuckDB SQL for the queries of this subpackage that SQL can express.

Packing, both classifiers, page extraction, offsets of tokens and the positions of
personal data are tested against brute force instead.
"""

from hostweave.llm import divergence, licenses, merkle, quality_rules as rules

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _quality_rules() -> str:
    listed = sorted({w for words in rules.COMMON_WORDS.values() for w in words})
    classes = ["n_lower", "n_upper", "n_digit", "n_symbols", "n_other"]

    def kept(characters: str) -> str:
        return f"length(regexp_replace(solid, '[^{characters}]+', '', 'g'))"

    def side(p: str, q: str) -> str:
        return f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END"

    def distance(pairs: list[tuple[str, str]], whole: str) -> str:
        total = " + ".join(f"{side(p, q)} + {side(q, p)}" for p, q in pairs)
        return f"CASE WHEN {whole} > 0 THEN sqrt(greatest(({total}) / 2, 0.0)) ELSE 1.0 END"

    sums = ", ".join([f"sum({c})::DOUBLE AS {c}" for c in classes] + ["sum(n_words)::DOUBLE AS n_words"] + [
        f"sum(t{i})::DOUBLE AS t{i}" for i in range(len(listed))])
    known = ", ".join(
        f"r_{name} AS (SELECT {sums} FROM counts WHERE lang = '{name}')" for name in rules.COMMON_WORDS)
    by_class, by_word, bare = [], [], []
    for name, words in rules.COMMON_WORDS.items():
        chars = " + ".join(f"r_{name}.{c}" for c in classes)
        by_class.append(distance(
            [(f"(c.{c}::DOUBLE / c.word_chars)", f"(r_{name}.{c} / ({chars}))") for c in classes], "c.word_chars"))
        own = [f"t{listed.index(w)}" for w in words]
        rest = lambda t: f"({t}.n_words - " + " - ".join(f"{t}.{o}" for o in own) + ")"
        by_word.append(distance(
            [(f"(c.{o}::DOUBLE / c.n_words)", f"(r_{name}.{o} / r_{name}.n_words)") for o in own]
            + [(f"({rest('c')}::DOUBLE / c.n_words)", f"({rest('r_' + name)} / r_{name}.n_words)")], "c.n_words"))
        bare.append(distance(
            [("0::DOUBLE", f"(r_{name}.{o} / r_{name}.n_words)") for o in own]
            + [("1::DOUBLE", f"({rest('r_' + name)} / r_{name}.n_words)")], "c.n_words"))

    def limit(fixed: float, by_words: float) -> str:
        return f"sqrt({fixed}::DOUBLE + {by_words}::DOUBLE / n_words)"

    times = ", ".join(f"len([x FOR x IN words IF x = {_quoted(w)}]) AS t{i}" for i, w in enumerate(listed))
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, {_WORDS.format('text')} AS words,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM base),
windows AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS k FROM windows) WHERE k > 1),
repeated AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
solid AS (
  SELECT s.rid, doc_id, lang, words, len(words) AS n_words, array_to_string(words, '') AS solid,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM split s LEFT JOIN repeated r ON s.rid = r.rid),
classed AS (
  SELECT doc_id, lang, n_words, n_dup_lines, n_repeat_words, length(solid) AS word_chars,
    {kept(rules.CLASSES['lower'])} AS n_lower, {kept(rules.CLASSES['upper'])} AS n_upper,
    {kept(rules.CLASSES['digit'])} AS n_digit, {kept(rules.CLASSES['symbol'])} AS n_symbols, {times} FROM solid),
counts AS (
  SELECT *, word_chars - n_lower - n_upper - n_digit - n_symbols AS n_other FROM classed),
{known},
judged AS (
  SELECT c.*, coalesce(least({', '.join(by_class)}), 0) AS class_distance,
    coalesce(least({', '.join(by_word)}), 0) AS word_distance,
    coalesce(least({', '.join(bare)}), 0) AS bare_distance,
    c.n_words < {rules.MIN_WORDS} OR 100 * c.n_repeat_words > {rules.MAX_REPEATED} * c.n_words AS base_failed
  FROM counts c, {', '.join(f'r_{n}' for n in rules.COMMON_WORDS)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT (word_chars >= {rules.CLASS_MIN_CHARS} AND class_distance > {limit(*rules.CLASS_LIMIT)})
  AND NOT (n_words >= {rules.WORDS_MIN} AND word_distance > least(
    {limit(*rules.WORD_LIMIT)}, greatest({rules.BARE_SHARE}::DOUBLE * bare_distance, {rules.BARE_MIN}::DOUBLE))) AS kept
FROM judged"""


def _shingled(k: int) -> str:
    """The distinct k-word shingles of ``words``; the whole sequence if it is shorter, none if empty."""
    parts = " || ' ' || ".join(f"words[i + {j}]" for j in range(k))
    return (f"CASE WHEN len(words) >= {k} THEN list_distinct([{parts} FOR i IN range(1, len(words) - {k - 2})])"
            " WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END")


_LICENSES = rf"""
WITH templates(license, template) AS (VALUES {', '.join(f'({_quoted(n)}, {_quoted(t)})' for n, t in licenses.TEMPLATES)}),
wanted AS (
  SELECT license, template, {_shingled(licenses.K)} AS own
  FROM (SELECT *, regexp_extract_all(lower(template), '[\p{{L}}\p{{N}}]+') AS words FROM templates)),
texts AS (
  SELECT doc_id, {_shingled(licenses.K)} AS own
  FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS words FROM documents)
  WHERE len(words) >= {licenses.K}),
rows AS (
  SELECT doc_id, license, template, len(w.own) AS n_template, len(list_intersect(w.own, t.own)) AS n_shared
  FROM texts t, wanted w)
SELECT * FROM rows WHERE 100 * n_shared >= {licenses.PERCENT} * n_template"""

_JACCARD = f"""
WITH RECURSIVE sets AS MATERIALIZED (
  SELECT doc_id, {_shingled(5)} AS own
  FROM (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS words
        FROM documents)),
tokens AS MATERIALIZED (SELECT doc_id, unnest(own) AS t FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sets x ON a = x.doc_id JOIN sets y ON b = y.doc_id
  WHERE 100 * k >= 75 * (len(x.own) + len(y.own) - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a, b FROM both_ways
  UNION
  SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT doc_id, len(own) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id"""

_ITEM_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),"
               r" '[0-9a-z\x{80}-\x{10FFFF}]+')")
_SHORT_ITEMS = " UNION ALL ".join(f"""
  SELECT doc_id, item_id, 1 AS n_item, 1 AS n_shared
  FROM (SELECT doc_id, unnest(list_distinct([array_to_string(words[i:i + {k - 1}], ' ') FOR i IN range(1, len(words) - {k - 2})])) AS t
        FROM (SELECT doc_id, words FROM texts WHERE len(words) >= {k} AND {k} IN (SELECT len(words) FROM items)))
  JOIN (SELECT DISTINCT item_id, text, array_to_string(words, ' ') AS t FROM items WHERE len(words) = {k}) USING (t)"""
    for k in range(1, 5))
_DECONTAMINATION = f"""
WITH items AS (
  SELECT item_id, text, words, {_shingled(5)} AS own
  FROM (SELECT DISTINCT item_id, text, {_ITEM_WORDS} AS words FROM benchmark)),
texts AS (
  SELECT doc_id, words, {_shingled(5)} AS own FROM (SELECT doc_id, {_ITEM_WORDS} AS words FROM documents)),
wanted AS (SELECT item_id, len(own) AS n_item, unnest(own) AS t FROM items WHERE len(words) >= 5),
held AS (SELECT doc_id, unnest(own) AS t FROM texts WHERE len(words) >= 5)
SELECT doc_id, item_id, n_item, count(*) AS n_shared
FROM held JOIN wanted USING (t) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item
UNION ALL {_SHORT_ITEMS}"""

_PRICE = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
_SHARE = f"1 + ({divergence.SCALE}::HUGEINT * ({{n}} + 2)) // ({{total}} + 2 * {{terms}})"
_DIVERGENCE = f"""
WITH base AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS text FROM documents),
words AS MATERIALIZED (
  SELECT lang, source, rid,
    unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM base),
kept AS MATERIALIZED (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term
  HAVING count(DISTINCT rid) >= {divergence.LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM kept GROUP BY lang),
members AS (SELECT DISTINCT lang, source FROM base),
counts AS MATERIALIZED (
  SELECT w.lang, source, term, count(*) AS n FROM words w JOIN kept k USING (lang, term) GROUP BY ALL),
sizes AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM members LEFT JOIN counts USING (lang, source) GROUP BY ALL),
dense AS MATERIALIZED (
  SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n,
    {_SHARE.format(n='coalesce(c.n, 0)', total='s.total', terms='l.terms')} AS p,
    {_SHARE.format(n='k.n', total='l.total', terms='l.terms')} AS q
  FROM members m JOIN kept k USING (lang) JOIN langs l USING (lang) JOIN sizes s USING (lang, source)
  LEFT JOIN counts c USING (lang, source, term)),
both_p AS (
  SELECT a.lang, a.source, b.source AS item, sum({_PRICE.format(p='a.p', q='b.p')}) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM members a JOIN members b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN both_p v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, {_PRICE.format(p='p', q='q')} FROM dense WHERE n > 0 AND p > q),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ordered WHERE part = 'pair' OR rank <= {divergence.TOP}"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


def _leaf(text: str) -> str:
    values = [text if c == "text" else f"{c}::VARCHAR" for c in merkle.LEAF_COLUMNS]
    return "sha256(" + " || ".join(map(_field, values)) + ")"


#: crc32 of a decimal text, byte by byte and bit by bit (fixed polynomial of the checksum).
_CRC32 = ("xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], "
          "list_transform(range(1, len({0}) + 1), lambda i: ord({0}[i])::BIGINT)), "
          "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))")


def _tree(name: str, nodes: str) -> str:
    """All nodes (grp, level, idx, n, hash) above ``nodes`` (grp, idx, n, hash), level by level."""
    return f"""{name} AS (
  SELECT grp, 0 AS level, idx, n, hash FROM {nodes}
  UNION ALL
  SELECT grp, level + 1, idx // {merkle.FAN}, (max(n) + {merkle.FAN - 1}) // {merkle.FAN},
    sha256(string_agg(hash, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY grp, level, idx // {merkle.FAN})"""


def _steps(name: str, tree: str, shift: str) -> str:
    """What stands left and right of every node below the top of its group."""
    own = f"PARTITION BY t.grp, t.level, t.idx // {merkle.FAN} ORDER BY t.idx ROWS BETWEEN"
    return f"""{name} AS (
  SELECT t.grp, t.level AS level, {shift} AS at, t.idx,
    coalesce(string_agg(hash, '') OVER ({own} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(hash, '') OVER ({own} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {tree} t WHERE n > 1)"""


_MERKLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source AS grp, {_leaf('text')} AS hash,
    CASE WHEN {_CRC32.format('(doc_id::VARCHAR)')} % 5 = 0
      THEN {_leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} ELSE {_leaf('text')} END AS copied
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, hash, rid) - 1 AS idx,
    count(*) OVER (PARTITION BY grp) AS n FROM leaves),
{_tree('own', 'placed')},
subroots AS MATERIALIZED (SELECT grp AS source, hash FROM own WHERE n = 1),
listed AS MATERIALIZED (
  SELECT 0 AS grp, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n, hash
  FROM subroots),
{_tree('whole', 'listed')},
root AS (SELECT hash AS root FROM whole WHERE n = 1),
heights AS (SELECT grp, max(level) AS height FROM own GROUP BY grp),
{_steps('own_steps', 'own', 't.level')},
{_steps('whole_steps', 'whole', 't.level')},
path AS MATERIALIZED (
  SELECT p.rid, s.level AS level, s.l, s.r FROM placed p JOIN own_steps s
    ON p.grp IS NOT DISTINCT FROM s.grp AND p.idx // ({merkle.FAN} ** s.level)::BIGINT = s.idx
  UNION ALL
  SELECT p.rid, h.height + s.level, s.l, s.r
  FROM placed p JOIN heights h ON p.grp IS NOT DISTINCT FROM h.grp
  JOIN listed x ON p.grp IS NOT DISTINCT FROM x.source
  JOIN whole_steps s ON x.idx // ({merkle.FAN} ** s.level)::BIGINT = s.idx),
proofs AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM path GROUP BY rid),
fold AS (
  SELECT rid, 0 AS level, copied AS hash FROM placed
  UNION ALL
  SELECT f.rid, f.level + 1, sha256(l || hash || r) FROM fold f JOIN path p ON f.rid = p.rid AND f.level = p.level),
ends AS (SELECT rid, arg_max(hash, level) AS folded_root FROM fold GROUP BY rid)
SELECT doc_id, p.hash AS leaf, s.hash AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM placed p JOIN ends USING (rid) LEFT JOIN proofs USING (rid) CROSS JOIN root
JOIN subroots s ON p.grp IS NOT DISTINCT FROM s.source"""

SQL: dict[str, str] = {
    "op2_quality_rules": _quality_rules(),
    "op3_license_scan": _LICENSES,
    "op4_jaccard_join": _JACCARD,
    "op9_decontamination": _DECONTAMINATION,
    "op12_source_divergence": _DIVERGENCE,
    "op13_merkle_manifest": _MERKLE,
}
