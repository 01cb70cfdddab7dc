"""Check queries: the same results in SQL over the given tables.

Expected symbols and imports come from the hand-written lists in ``templates``
joined to the parts; no text is parsed here.
"""

from __future__ import annotations

from codeloom.functions import fixed_values as fixed

from .templates import JS_FAMILY, KINDS, LANGUAGES, TEMPLATES

def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else text(v) for v in row) + ")"
        for row in rows
    )


def _list(items) -> str:
    return "[" + ", ".join(text(i) for i in items) + "]"


def in_list(items) -> str:
    return "(" + ", ".join(text(i) for i in items) + ")"


PARTS = f"""parts AS (
  SELECT p_brand AS repo, p_partkey AS k, p_partkey // {len(LANGUAGES)} AS turn,
    {_list(LANGUAGES)}[(p_partkey % {len(LANGUAGES)} + 1)::INT] AS lang,
    {_list(t.ext for t in LANGUAGES.values())}[(p_partkey % {len(LANGUAGES)} + 1)::INT] AS e,
    {_list(KINDS)}[(p_size % {len(KINDS)} + 1)::INT] || '_' || (p_size % 2) AS stem,
    {_list(KINDS)}[((p_size + 3) % {len(KINDS)} + 1)::INT] || '_' || (p_size % 2) AS alias,
    CASE WHEN p_partkey % 41 = 0 THEN '' ELSE lower(p_type) || '/' ||
      CASE WHEN p_partkey % 29 = 0 THEN 'build' WHEN p_partkey % 31 = 0 THEN 'node_modules'
           WHEN p_partkey % 37 = 0 THEN '.dist-info' ELSE split_part(p_name, ' ', 1) END
      || '/m' || p_partkey END AS dir
  FROM part)"""

FILES = f"""named AS (
  SELECT *, stem || CASE WHEN dir = '' OR lang = 'proto' THEN '_' || k ELSE '' END AS base
  FROM parts),
every AS (
  SELECT repo, k, turn, alias, lang AS kind, dir,
    base || CASE WHEN lang = 'go' AND k % 5 = 0 THEN '.GO' ELSE e END AS name FROM named
  UNION ALL SELECT repo, k, turn, alias, 'helper', dir,
    CASE WHEN lang = 'js' AND turn % 4 = 1 THEN 'helper.js' ELSE 'helper.ts' END FROM named
    WHERE lang IN {in_list(JS_FAMILY)} AND dir <> ''
  UNION ALL SELECT repo, k, turn, alias, 'helper', 'packages/' || dir, 'helper.ts' FROM named
    WHERE lang = 'js' AND turn % 4 = 1 AND dir <> ''
  UNION ALL SELECT repo, k, turn, alias, 'pystub', '', base || '_pb2_grpc.py' FROM named
    WHERE lang = 'proto' AND turn % 2 = 0
  UNION ALL SELECT repo, k, turn, alias, 'gostub', '', base || '.pb.go' FROM named
    WHERE lang = 'proto' AND turn % 4 = 0),
all_files AS (
  SELECT repo, k, turn, alias, kind, dir, name,
    CASE WHEN dir = '' THEN name ELSE dir || '/' || name END AS file_id,
    lower('.' || split_part(name, '.', -1)) AS ext FROM every),
pruned AS (
  SELECT * FROM all_files
  WHERE NOT list_has_any(string_split(dir, '/'), {_list(fixed.IGNORED_DIRS)})),
files AS (SELECT * FROM pruned WHERE ext <> '.txt')"""

BASE = f"WITH RECURSIVE {PARTS}, {FILES}"


def _symbol_rows(which: str = "symbols"):
    for kind, t in TEMPLATES.items():
        for row in getattr(t, which):
            yield (kind, 0, *row)
        if which == "symbols":
            for row in t.more_symbols:
                yield (kind, 1, *row)


def _import_rows(which: str = "imports"):
    for kind, t in TEMPLATES.items():
        for row in getattr(t, which):
            yield (kind, *row)


def filled(column: str) -> str:
    here = "CASE WHEN f.dir = '' THEN '' ELSE f.dir || '/' END"
    up = (
        "CASE WHEN contains(f.dir, '/') THEN regexp_replace(f.dir, '[^/]*$', '') ELSE '' END"
    )
    out = f"replace(replace({column}, '{{k}}', f.k::VARCHAR), '{{alias}}', f.alias)"
    return f"replace(replace({out}, '{{here}}', {here}), '{{up}}', {up})"


def symbols(files: str = "files", which: str = "symbols", name: str = "symbols") -> str:
    return f"""{name} AS (
  SELECT f.repo, f.file_id, f.kind, f.ext, x.stage::INT AS stage, x.pos::BIGINT AS pos,
    CASE WHEN x.parent IS NULL THEN f.file_id
         ELSE f.file_id || '::' || {filled('x.parent')} END AS parent_id,
    f.file_id || '::' || {filled('x.name')} AS node_id, x.type AS node_type
  FROM {files} f JOIN (VALUES {values(_symbol_rows(which))})
    x(kind, more, stage, pos, parent, name, type)
    ON f.kind = x.kind AND (x.more = 0 OR f.turn % 3 = 0))"""


def imports(files: str = "files", which: str = "imports", name: str = "imports") -> str:
    return f"""{name} AS (
  SELECT f.repo, f.file_id, f.dir, f.ext, x.stage::INT AS stage, x.pos::BIGINT AS pos,
    {filled('x.raw')} AS raw, x.ikind AS kind
  FROM {files} f JOIN (VALUES {values(_import_rows(which))}) x(kind, stage, pos, raw, ikind)
    ON f.kind = x.kind)"""


# alias requests against every trailing sub-path, all hits paired and ranked
SUFFIXES = """suffixes AS (
  SELECT repo, file_id, array_to_string(parts[i:], '/') AS suffix
  FROM (SELECT repo, file_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT repo, file_id, string_split(file_id, '/') AS parts FROM files)))"""

SPELLINGS = "(VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), \
(5, '/index.ts'), (6, '/index.tsx'), (7, '/index.js'))"


def resolved(requests: str = "requests") -> str:
    """CTEs ending in ``resolved(repo, file_id, alias, target)``."""
    return f"""{SUFFIXES},
hits AS (
  SELECT DISTINCT r.repo, r.file_id, r.alias, s.rank, x.file_id AS hit,
    len(list_filter(range(1, 1 + least(len(string_split(r.file_id, '/')),
                                       len(string_split(x.file_id, '/')))),
      lambda i: string_split(r.file_id, '/')[1:i] = string_split(x.file_id, '/')[1:i])) AS shared
  FROM {requests} r, {SPELLINGS} s(rank, tail), suffixes x
  WHERE x.repo = r.repo AND x.suffix = r.alias || s.tail),
resolved AS (
  SELECT repo, file_id, alias, hit AS target FROM hits
  QUALIFY row_number() OVER (PARTITION BY repo, file_id, alias
                             ORDER BY rank, shared DESC, hit) = 1)"""


REQUESTS = """js_imports AS (
  SELECT *, (raw LIKE '@%' OR raw LIKE './%' OR raw LIKE '../%' OR raw LIKE '~/%'
             OR raw LIKE 'src/%' OR raw LIKE 'packages/%') AS internal,
    replace(replace(replace(raw, '@/', ''), '~/', ''), 'src/', '') AS cleaned
  FROM imports WHERE kind = 'js' AND raw NOT LIKE 'node:%'),
looked AS (
  SELECT *, CASE
    WHEN cleaned LIKE './%' THEN CASE WHEN dir = '' THEN '' ELSE dir || '/' END || cleaned[3:]
    WHEN cleaned LIKE '../%' THEN
      CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '[^/]*$', '') ELSE '' END || cleaned[4:]
    ELSE cleaned END AS alias,
    cleaned LIKE './%' OR cleaned LIKE '../%' AS dotted
  FROM js_imports WHERE internal),
requests AS (SELECT DISTINCT repo, file_id, alias FROM looked)"""

# a relative path names the file at that very place before any other
ROUTED = f"""at_place AS (
  SELECT r.repo, r.alias, min_by(f.file_id, s.rank) AS file_id
  FROM (SELECT DISTINCT repo, alias FROM looked WHERE dotted) r, {SPELLINGS} s(rank, tail), files f
  WHERE f.repo = r.repo AND f.file_id = r.alias || s.tail GROUP BY r.repo, r.alias),
routed AS (
  SELECT repo, file_id, stage, pos, split_part(split_part(raw, '/', 1), '@', 1) AS raw,
    'npm_package' AS kind FROM js_imports WHERE NOT internal
  UNION ALL
  SELECT l.repo, l.file_id, l.stage, l.pos, coalesce(e.file_id, t.target, l.cleaned),
    CASE WHEN coalesce(e.file_id, t.target) IS NULL THEN 'alias' ELSE 'resolved' END
  FROM looked l LEFT JOIN resolved t USING (repo, file_id, alias)
  LEFT JOIN at_place e ON l.dotted AND e.repo = l.repo AND e.alias = l.alias
  UNION ALL
  SELECT repo, file_id, stage, pos, raw, kind FROM imports WHERE kind <> 'js')"""

FOLDERS = """folders AS (
  SELECT DISTINCT repo, CASE WHEN path = '' THEN 'root' ELSE path END AS folder,
    CASE WHEN path = '' THEN NULL WHEN contains(path, '/')
         THEN regexp_replace(path, '/[^/]*$', '') ELSE 'root' END AS parent
  FROM (SELECT repo, array_to_string(parts[:i], '/') AS path
        FROM (SELECT repo, string_split(dir, '/') AS parts,
                     unnest(range(0, len(string_split(dir, '/')) + 1)) AS i
              FROM (SELECT DISTINCT repo, dir FROM pruned))))"""

FILE_CLASS = """CASE
    WHEN regexp_matches(lower(name), 'component|screen|provider') THEN 'component'
    WHEN contains(lower(name), 'route') THEN 'router'
    WHEN contains(lower(name), 'service') THEN 'service'
    WHEN regexp_matches(lower(name), 'model|schema') THEN 'model'
    WHEN regexp_matches(lower(name), 'test|spec') THEN 'test'
    WHEN regexp_matches(lower(name), 'index|main') THEN 'main'
    WHEN contains(lower(name), 'grpc') THEN 'grpc'
    ELSE 'file' END"""

NODES = f"""candidates AS (
  SELECT repo, folder AS node_id, 'folder' AS node_type, false AS external,
    0 AS c, folder AS f, 0 AS stage, 0::BIGINT AS pos FROM folders
  UNION ALL SELECT repo, file_id, {FILE_CLASS}, false, 0, file_id, 1, 0 FROM files
  UNION ALL SELECT repo, node_id, node_type, false, 1, file_id, stage, pos FROM symbols
  UNION ALL SELECT repo, raw, kind, kind <> 'alias', 2, file_id, stage, pos FROM routed
    WHERE kind NOT IN ('includes', 'implements', 'path', 'resolved') AND raw <> ''),
known AS (
  SELECT repo, node_id, node_type, external, c, f, stage, pos FROM candidates
  QUALIFY row_number() OVER (PARTITION BY repo, node_id
                             ORDER BY c, f, stage, pos, node_type) = 1)"""

EDGES = """stubs AS (
  SELECT s.repo, s.node_id AS src,
    regexp_replace(split_part(s.file_id, '/', -1), '\\.proto$', '') || t.tail AS dst
  FROM symbols s, (VALUES ('_pb2_grpc.py'), ('.pb.go')) t(tail)
  WHERE s.node_type = 'service' AND s.ext = '.proto'),
edges AS (
  SELECT DISTINCT repo, src, dst, type FROM (
    SELECT repo, parent AS src, folder AS dst, 'contains' AS type FROM folders
      WHERE parent IS NOT NULL
    UNION ALL SELECT repo, CASE WHEN dir = '' THEN 'root' ELSE dir END, file_id, 'contains'
      FROM files
    UNION ALL SELECT repo, parent_id, node_id, 'defines' FROM symbols
    UNION ALL SELECT repo, file_id, raw,
      CASE WHEN kind IN ('includes', 'implements') THEN kind ELSE 'imports' END FROM routed
    UNION ALL SELECT repo, src, dst, 'generates' FROM stubs
      WHERE (repo, dst) IN (SELECT repo, node_id FROM known))
  WHERE src <> '' AND dst <> '' AND src <> dst),
nodes AS (
  SELECT * FROM known
  UNION ALL SELECT DISTINCT repo, dst, 'unresolved', true, 3, dst, 0, 0 FROM edges e
    WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.repo = e.repo AND k.node_id = e.dst))"""

SOURCE_GRAPH = ",\n".join(
    [BASE, symbols(), imports(), REQUESTS, resolved(), ROUTED, FOLDERS, NODES, EDGES]
)

FK_GRAPH = """WITH RECURSIVE places AS (
  SELECT n_nationkey, n_regionkey, r_name AS repo FROM nation JOIN region
    ON n_regionkey = r_regionkey),
buyers AS (SELECT c_custkey, c_nationkey, repo FROM customer JOIN places
    ON c_nationkey = n_nationkey),
placed AS (SELECT o_orderkey, o_custkey, repo FROM orders JOIN buyers ON o_custkey = c_custkey),
bought AS (SELECT l_orderkey, l_partkey, l_suppkey, repo FROM lineitem JOIN placed
    ON l_orderkey = o_orderkey),
edges AS (SELECT DISTINCT * FROM (
  SELECT repo, 'region/' || n_regionkey AS src, 'nation/' || n_nationkey AS dst,
    'contains' AS type FROM places
  UNION ALL SELECT repo, 'nation/' || c_nationkey, 'customer/' || c_custkey, 'contains' FROM buyers
  UNION ALL SELECT repo, 'customer/' || o_custkey, 'order/' || o_orderkey, 'contains' FROM placed
  UNION ALL SELECT repo, 'order/' || l_orderkey, 'part/' || l_partkey, 'imports' FROM bought
  UNION ALL SELECT repo, 'order/' || l_orderkey, 'supplier/' || l_suppkey, 'imports' FROM bought)),
nodes AS (SELECT DISTINCT * FROM (
  SELECT r_name AS repo, 'region/' || r_regionkey AS node_id, 'folder' AS node_type,
    false AS external FROM region
  UNION ALL SELECT repo, 'nation/' || n_nationkey, 'folder', false FROM places
  UNION ALL SELECT repo, 'customer/' || c_custkey, 'class', false FROM buyers
  UNION ALL SELECT repo, 'order/' || o_orderkey, 'function', false FROM placed
  UNION ALL SELECT repo, 'part/' || l_partkey, 'module', true FROM bought
  UNION ALL SELECT repo, 'supplier/' || l_suppkey, 'module', true FROM bought))"""

EVENT_GRAPH = """WITH RECURSIVE raw_edges AS (
  SELECT strftime(ts, '%Y-%m-%d') AS repo, 'user/' || user_id AS u,
    'k/' || json_extract_string(props, '$.k') AS key, event_type AS type FROM events),
edges AS (SELECT DISTINCT repo,
    CASE WHEN type IN ('error', 'signup') THEN key ELSE u END AS src,
    CASE WHEN type IN ('error', 'signup') THEN u ELSE key END AS dst, type
  FROM raw_edges WHERE key IS NOT NULL),
known AS (SELECT DISTINCT repo, u AS node_id, 'class' AS node_type, false AS external
  FROM raw_edges),
nodes AS (
  SELECT * FROM known UNION ALL
  SELECT DISTINCT repo, dst, 'unresolved', true FROM edges e
  WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.repo = e.repo AND k.node_id = e.dst))"""

PAGE_LINKS = """WITH RECURSIVE bare AS (
  SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS src, html
  FROM pages),
links AS (
  SELECT split_part(src, '/', 1) AS repo, src,
    unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst, 'imports' AS type FROM bare),
edges AS (SELECT DISTINCT repo, src, dst, type FROM links
  WHERE src <> '' AND dst <> '' AND src <> dst)"""

PAIRS = "pairs AS (SELECT DISTINCT repo, src, dst FROM edges)"
DEGREES = """ends AS (SELECT repo, src AS node_id FROM pairs UNION ALL SELECT repo, dst FROM pairs),
every_node AS (SELECT repo, node_id FROM nodes UNION SELECT repo, node_id FROM ends),
counted AS (SELECT repo, node_id, count(*) AS degree FROM ends GROUP BY ALL),
degrees AS (
  SELECT n.repo, n.node_id, coalesce(c.degree, 0)::BIGINT AS degree
  FROM every_node n LEFT JOIN counted c USING (repo, node_id))"""


def gods(top: int) -> str:
    return f"""gods AS (
  SELECT d.repo, coalesce(n.external, false) AS external,
    row_number() OVER (PARTITION BY d.repo, coalesce(n.external, false)
                       ORDER BY d.degree DESC, d.node_id) AS rank, d.node_id, d.degree
  FROM degrees d LEFT JOIN nodes n USING (repo, node_id)
  WHERE n.node_type IS NULL OR n.node_type <> 'folder'
  QUALIFY rank <= {top})"""


def ranks(rounds: int) -> str:
    """PageRank unrolled: CTEs ending in ``ranks(repo, node_id, rank)``."""
    ctes = [
        PAIRS,
        """verts AS (SELECT repo, node_id FROM nodes UNION SELECT repo, src FROM edges),
sizes AS (SELECT repo, count(*) AS n FROM verts GROUP BY repo),
outs AS (SELECT repo, src, count(*) AS deg FROM pairs GROUP BY repo, src),
r0 AS MATERIALIZED (
  SELECT v.repo, v.node_id, 1.0::DOUBLE / s.n AS rank, s.n, o.deg
  FROM verts v JOIN sizes s USING (repo) LEFT JOIN outs o
    ON o.repo = v.repo AND o.src = v.node_id)""",
    ]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        ctes.append(f"""i{i} AS (SELECT repo, sum(rank) AS idle FROM {p} WHERE deg IS NULL
  GROUP BY repo),
g{i} AS (SELECT p.repo, p.dst AS node_id, sum(r.rank / r.deg) AS got
  FROM pairs p JOIN {p} r ON r.repo = p.repo AND r.node_id = p.src GROUP BY ALL),
r{i} AS MATERIALIZED (
  SELECT v.repo, v.node_id, 0.85 * coalesce(g.got, 0)
    + (0.85 * coalesce(i.idle, 0) + (1.0::DOUBLE - 0.85::DOUBLE)) / v.n AS rank, v.n, v.deg
  FROM {p} v LEFT JOIN g{i} g USING (repo, node_id) LEFT JOIN i{i} i USING (repo))""")
    ctes.append(f"ranks AS (SELECT repo, node_id, rank FROM r{rounds})")
    return ",\n".join(ctes)


def settled_ranks(rounds: int = fixed.PAGERANK_MAX_ROUNDS) -> str:
    """PageRank with each repository frozen once a round's summed change is below its node
    count times the tolerance; one that never gets there has rank 1."""
    tolerance = f"{fixed.PAGERANK_TOLERANCE:.9f}::DOUBLE"
    start = ranks(0).rsplit(",\n", 1)[0].replace(
        "1.0::DOUBLE / s.n AS rank, s.n, o.deg", "1.0::DOUBLE / s.n AS rank, s.n, o.deg, true AS moving"
    )
    ctes = [start]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        ctes.append(f"""i{i} AS (SELECT repo, sum(rank) AS idle FROM {p} WHERE moving AND deg IS NULL GROUP BY repo),
g{i} AS (SELECT p.repo, p.dst AS node_id, sum(r.rank / r.deg) AS got
  FROM pairs p JOIN {p} r ON r.repo = p.repo AND r.node_id = p.src WHERE r.moving GROUP BY ALL),
f{i} AS (SELECT v.repo, v.node_id, v.n, v.deg, v.rank AS before, v.moving,
    CASE WHEN v.moving THEN 0.85 * coalesce(g.got, 0)
      + (0.85 * coalesce(i.idle, 0) + (1.0::DOUBLE - 0.85::DOUBLE)) / v.n ELSE v.rank END AS rank
  FROM {p} v LEFT JOIN g{i} g USING (repo, node_id) LEFT JOIN i{i} i USING (repo)),
r{i} AS MATERIALIZED (
  SELECT repo, node_id, rank, n, deg,
    moving AND sum(abs(rank - before)) OVER (PARTITION BY repo) >= n * {tolerance} AS moving FROM f{i})""")
    ctes.append(f"ranks AS (SELECT repo, node_id, CASE WHEN moving THEN 1.0 ELSE rank END AS rank FROM r{rounds})")
    return ",\n".join(ctes)


KEEP = """kept AS (
  SELECT n.* FROM nodes n JOIN ranks r USING (repo, node_id)
  WHERE NOT n.external AND CASE
    WHEN NOT contains(n.node_id, '::') THEN n.node_type = 'folder' OR n.node_type IN {important}
    ELSE length({symbol}) >= 3 AND NOT starts_with({symbol}, '_')
      AND NOT starts_with(lower({symbol}), 'test') AND lower({symbol}) NOT IN {noise}
      AND r.rank > CASE WHEN n.node_type IN {important} THEN 0.000001 ELSE 0.00001 END
    END)""".format(
    symbol="substr(n.node_id, position('::' IN n.node_id) + 2)",
    important=in_list(fixed.IMPORTANT_TYPES),
    noise=in_list(fixed.NOISE_SYMBOLS),
)

SMART_EDGES = """flagged AS (
  SELECT e.*, (e.repo, e.src) IN (SELECT repo, node_id FROM kept) AS s,
    (e.repo, e.dst) IN (SELECT repo, node_id FROM kept) AS d FROM edges e),
smart AS (
  SELECT repo, src, dst, type FROM flagged WHERE s AND d
  UNION SELECT f.repo, f.src, p.dst, f.type FROM flagged f JOIN pairs p
    ON p.repo = f.repo AND p.src = f.dst
    WHERE f.s AND NOT f.d AND (p.repo, p.dst) IN (SELECT repo, node_id FROM kept)
  UNION SELECT f.repo, p.src, f.dst, f.type FROM flagged f JOIN pairs p
    ON p.repo = f.repo AND p.dst = f.src
    WHERE f.d AND NOT f.s AND (p.repo, p.src) IN (SELECT repo, node_id FROM kept))"""


def page_name(column: str) -> str:
    name = f"replace({column}, '\\', '/')"
    clean = (
        "trim(regexp_replace(regexp_replace("
        f"{name}, '[\\\\/:*?\"<>|()\\n\\r\\t]', '_', 'g'), '_+', '_', 'g'), '_')"
    )
    return (
        f"(CASE WHEN length({clean}) > 140 THEN substr({clean}, 1, 120) || '__' || "
        f"substr(sha1({name}), 1, 10) WHEN {clean} = '' THEN 'unnamed_node' ELSE {clean} END)"
    )


def wiki(column: str) -> str:
    return f"'[[' || {page_name(column)} || ']]'"


# every file with its symbols is one community, numbered by file id
BY_FILE = """owners AS (
  SELECT repo, node_id, split_part(node_id, '::', 1) AS owner, node_type, external FROM nodes
  WHERE NOT external AND node_type <> 'folder' AND node_type <> 'alias'),
labelled AS (
  SELECT repo, node_id, dense_rank() OVER (PARTITION BY repo ORDER BY owner) - 1 AS community
  FROM owners),
grouped AS (
  SELECT n.*, coalesce(l.community, -1)::INT AS community
  FROM nodes n LEFT JOIN labelled l USING (repo, node_id))"""
