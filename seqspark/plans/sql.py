"""SQL fragments shared by the oracle statements."""

from seqspark.consts import PLAIN_SPECIALS
from seqspark.functions.hashing import ADD, MUL, P
from seqspark.plans.base import NWORDS, THRESHOLD

WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WHITE}+'), lambda w: w <> '')"


def fifth(y: str) -> str:
    return f"list_transform([{y}], lambda y: ((y * y % {P}) * (y * y % {P}) % {P}) * y % {P})[1]"


def base(seed: int, *values: str) -> str:
    acc = str(pow((seed * MUL + ADD) % P, 5, P))
    for v in values:
        acc = fifth(f"(({acc})::BIGINT * {MUL} + ({v})::BIGINT % {P} + {ADD}) % {P}")
    return acc


def unit(seed: int, *values: str) -> str:
    return f"({base(seed, *values)} / {float(P)}::DOUBLE)"


LINES = """lines AS (
  SELECT doc_id, lang, source, unnest(ls) AS line, unnest(range(len(ls))) AS line_no
  FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents))"""

WORDS = f"""{LINES},
words AS (SELECT doc_id, lang, source, line_no, line, {words('line')} AS words FROM lines)"""

TOKENS = f"""{WORDS},
tok AS (SELECT doc_id, lang, source, line_no, unnest(words) AS token, unnest(range(len(words))) AS pos FROM words)"""

def finalize(counts: str, threshold: int, nwords: int, pad: int = 8, names: list[str] = PLAIN_SPECIALS) -> str:
    """``vocab`` from a table of ``(token, cnt, first)``."""
    k = len(names)
    rows = ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(names))
    listed = ", ".join(f"'{t}'" for t in names)
    keep = f"AND rn <= {nwords - k}" if nwords > 0 else ""
    return f"""ranked AS (
  SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, first) AS rn
  FROM {counts} WHERE token NOT IN ({listed})),
kept AS (SELECT {k - 1} + rn AS token_id, token, cnt FROM ranked WHERE cnt >= {threshold} {keep}),
vocab AS (
  SELECT s.token_id, s.token, coalesce(c.cnt, 0) AS cnt, true AS is_special
  FROM (VALUES {rows}) s(token_id, token) LEFT JOIN {counts} c USING (token)
  UNION ALL SELECT token_id, token, cnt, false FROM kept
  UNION ALL SELECT n + i, printf('madeupword%04d', i), 0, false
  FROM (SELECT count(*) + {k} AS n FROM kept), range({pad}) r(i) WHERE i < ({pad} - n % {pad}) % {pad})"""


COUNTS = f"""{TOKENS},
counts AS (
  SELECT token, count(*) AS cnt,
         min(doc_id::HUGEINT * 4611686018427387904 + line_no * 2147483648 + pos) AS first
  FROM tok GROUP BY token
  UNION ALL SELECT '</s>', count(*), NULL FROM lines)"""

VOCAB = f"{COUNTS},\n{finalize('counts', THRESHOLD, NWORDS)}"

# One row per token with its id; `ids` is the same per line, without the end mark.
ENCODED = f"""{VOCAB},
enc AS (SELECT t.*, coalesce(v.token_id, 3) AS token_id FROM tok t LEFT JOIN vocab v USING (token))"""

# Ends a query over lines: a blank line has no token and one row.
BY_LINE = "FROM words w LEFT JOIN enc e ON e.doc_id = w.doc_id AND e.line_no = w.line_no GROUP BY w.doc_id, w.line_no"

# One row per token and end mark, numbered inside its document.
STREAM = f"""{ENCODED},
marked AS (
  SELECT doc_id, line_no, pos, token, token_id FROM enc
  UNION ALL SELECT doc_id, line_no, len(words), '</s>', 2 FROM words),
stream AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, line_no, pos) - 1 AS g FROM marked)"""

PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.conv_id * 4294967296 + u.turn AS id, u.text AS source, a.text AS target
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

PAIR_WORDS = f"""{PAIRS},
pw AS (SELECT id, conv_id, turn, {words('source')} AS sw, {words('target')} AS tw FROM pairs)"""

# Words longer than three characters are cut into two marked pieces; `wi` is found again by
# counting the pieces before that end a word.
PIECES = f"""{WORDS},
raw AS (SELECT doc_id, line_no, flatten(list_transform(words, lambda w: CASE WHEN length(w) > 3
  THEN [substr(w, 1, 3) || '@@', substr(w, 4)] ELSE [w] END)) || ['</s>'] AS p FROM words),
exploded AS (SELECT doc_id, line_no, unnest(p) AS piece, unnest(range(len(p))) AS pos FROM raw),
pieces AS (SELECT *, coalesce(sum(CASE WHEN piece LIKE '%@@' THEN 0 ELSE 1 END) OVER (
  PARTITION BY doc_id, line_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS wi,
  max(pos) OVER (PARTITION BY doc_id, line_no) AS last_pos FROM exploded)"""
