"""DuckDB SQL with the results of those corpus queries that SQL can express."""
from __future__ import annotations

from titerflow.llm.chat import CONTROL, END, SAYS, TURN

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _folded(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOW}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, {_quoted(c)}, {_quoted(c[0] + chr(92) + c[1:])})"
    return out


#: All pairs that share a shingle, exact similarities, then everything reachable over links.
OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_folded('text')}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

OP2 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text)) AS said,
        coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (role = 'assistant'), '') AS loss,
        sum(length({_escaped('role')}) + length({_escaped('text')}) + {len(TURN + SAYS + END)}) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""

#: Every benchmark item has five words at least.
OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_folded('text')}, '{LETTERS}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_folded('text')}, '{LETTERS}') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
i5 AS (SELECT DISTINCT item_id, array_to_string(w[k:k+4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n FROM i5 GROUP BY item_id)
SELECT doc_id, item_id, n AS item_shingles, count(*) AS shared, count(*) / n AS containment FROM ds JOIN i5 USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) * 100 >= n * 80"""

OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
v AS (SELECT doc_id, k, array_to_string(w[k:k+19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS rn FROM v) WHERE rn > 1),
cut AS (SELECT DISTINCT doc_id, k + j AS k FROM late CROSS JOIN range(0, 20) AS t(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN cut USING (doc_id, k) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

#: Scores in whole numbers; ``//`` rounds down.
OP11 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_folded('text')}, '{LETTERS}') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM t GROUP BY doc_id, term),
c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p CROSS JOIN c GROUP BY term),
i AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all({_folded('text')}, '{LETTERS}')) AS term FROM benchmark) GROUP BY item_id, term),
s AS (SELECT item_id, doc_id, CAST(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms))))) AS BIGINT) AS score
      FROM i JOIN p USING (term) JOIN df USING (term) CROSS JOIN c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10"""

OP12 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""

#: The checksum byte by byte, then words joined by what they leave when one letter goes.
OP13 = f"""
WITH RECURSIVE k AS (SELECT list(list_reduce(range(0, 8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(0, 256) AS r(b)),
o AS (SELECT doc_id, unnest(regexp_extract_all({_folded('text')}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM o WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS h FROM d CROSS JOIN k),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
g AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word, b.word AS other, b.n FROM g a JOIN g b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT g.word, w.word, w.n FROM g JOIN w ON w.word = g.less UNION SELECT w.word, g.word, g.n FROM g JOIN w ON w.word = g.less),
b AS (SELECT word, count(*) AS n_near, max(n) AS top FROM e GROUP BY word),
f AS (SELECT word, min(other) AS form FROM e JOIN b USING (word) WHERE n = top GROUP BY word),
v AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN form END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n
      FROM w LEFT JOIN b USING (word) LEFT JOIN f USING (word)),
r AS (SELECT word, word AS root, 0 AS step FROM v UNION ALL SELECT r.word, v.form, step + 1 FROM r JOIN v ON v.word = r.root AND v.form IS NOT NULL),
z AS (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM v JOIN z USING (word)"""

FORMS = {
    "op1_minhash_near_dedup": OP1,
    "op2_chat_formatting": OP2,
    "op5_benchmark_decontamination": OP5,
    "op10_substring_dedup": OP10,
    "op11_ranked_search": OP11,
    "op12_warc": OP12,
    "op13_spelling_variants": OP13,
}
