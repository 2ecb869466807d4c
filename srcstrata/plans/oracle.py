"""The registered queries in DuckDB SQL, written on their own from the rules.

``VIEWS`` hold the adapters' tables; a query gets those it names as CTEs.
"""

from __future__ import annotations

import re

CUT = "timestamp '1998-06-01 00:00:00'"
CODE = "cast(substr(o_orderpriority, 1, 1) as int)"

# Regex dialect differs in letters outside ASCII only; see README.
_CLASS = r"'\b(?:class|interface|enum|record)\s+([A-Za-z_$][\w$]*)'"
_PY_CLASS = r"'^\s*class\s+([A-Za-z_][\w]*)'"
_JAVA = r"'\b([A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?\{?'"
_FUNCTION = r"'\bfunction\s+([A-Za-z_$][\w$]*)\s*\('"
_ARROW = (r"'\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?"
          r"(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>'")
_PY_DEF = r"'^\s*def\s+([A-Za-z_][\w]*)\s*\('"
_KEYWORDS = "('if','for','while','switch','catch','return','new','throw','else','do')"


def _all(line: str, pattern: str) -> str:
    return f"regexp_extract_all({line}, {pattern}, 1)"


VIEWS: dict[str, str] = {
    "repositories": """
        select c_custkey * 2 as id, c_name as name,
               'https://git.example/' || lower(c_mktsegment) || '/' || c_name || '.git' as url,
               timestamp '1995-01-01' as created_at, timestamp '1995-01-01' as updated_at
        from customer
        union all
        select s_suppkey * 2 + 1, s_name, 'https://git.example/supply/' || s_name || '.git',
               timestamp '1995-01-01', timestamp '1997-01-01' from supplier""",
    "branches": f"""
        select id, repository_id, name,
               code = min(code) over (partition by repository_id)
               or (repository_id % 100 = 0 and code = max(code) over (partition by repository_id))
               as is_default,
               md5(cast(k as varchar)) as last_seen_commit_sha,
               md5(cast(k as varchar)) as last_scanned_commit_sha, created_at, updated_at
        from (select o_custkey * 20 + {CODE} as id, o_custkey * 2 as repository_id,
                     o_orderpriority as name, {CODE} as code, max(o_orderkey) as k,
                     min(o_orderdate) as created_at, max(o_orderdate) as updated_at
              from orders group by o_custkey, o_orderpriority)""",
    "commits": """
        select o_orderkey as id, o_custkey * 2 as repository_id,
               case when o_orderkey % 997 = 0 then ' ' else md5(cast(o_orderkey as varchar)) end as sha,
               'Author ' || o_orderstatus as author_name,
               lower(o_orderstatus) || '@example.org' as author_email,
               'order ' || o_orderkey || ' ' || o_orderpriority as message,
               o_orderdate as committed_at, o_orderdate as discovered_at
        from orders""",
    "branch_commits": f"""
        select o_orderkey as id, o_custkey * 2 as repository_id, o_custkey * 20 + {CODE} as branch_id,
               o_orderkey as commit_id, o_orderdate as first_seen_at from orders""",
    "scan_runs": f"""
        select o_orderkey as id, o_custkey * 2 as repository_id, o_custkey * 20 + {CODE} as branch_id,
               cast(null as varchar) as base_commit_sha,
               md5(cast(o_orderkey as varchar)) as head_commit_sha,
               case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'pending' end
               as status,
               case {CODE} when 1 then 'webhook' when 2 then 'scheduled' when 5 then 'nightly'
               else 'manual' end as trigger_type,
               o_orderdate as started_at,
               case when o_orderstatus = 'F' then
                    case when o_orderkey % 1000 = 7 then o_orderdate - interval 1 day
                    else o_orderdate end end as completed_at,
               cast(null as varchar) as error_message
        from orders""",
    "file_changes": """
        select l_orderkey as scan_run_id,
               case when l_linenumber = 1 and l_partkey % 9 = 0 then ' '
                    else 'src/p' || (l_partkey % 50) || '.java' end as path,
               case l_returnflag when 'A' then 'added' when 'R' then 'removed' else 'modified' end
               as change_type,
               cast(l_quantity as int) - 2 as additions, l_linenumber - 1 as deletions
        from lineitem""",
    "analysis_artifacts": f"""
        select o_orderkey as id, o_custkey * 2 as repository_id,
               case when {CODE} <> 5 then o_custkey * 20 + {CODE} end as branch_id,
               case when o_orderstatus = 'F' then o_orderkey end as scan_run_id,
               case o_orderkey % 6 when 0 then 'llm_context' when 1 then 'summary'
                    when 2 then 'diff_patch' when 3 then 'metrics' when 4 then 'risk_report'
                    else 'unknown' end as artifact_type,
               case o_orderkey % 5 when 0 then 'json' when 1 then 'markdown' when 2 then 'patch'
                    when 3 then 'text' else 'xml' end as format,
               case when o_orderkey % 1009 = 0 then ' '
                    else 's3://artifacts/' || o_custkey || '/' || strftime(o_orderdate, '%Y-%m-%d')
               end as uri,
               md5(o_orderpriority) as content_hash, o_orderdate as generated_at
        from orders""",
    "repository_metrics": f"""
        select o_custkey * 2 as repository_id, o_custkey * 20 + {CODE} as branch_id,
               cast(l_shipdate as date) as date, max(o_orderkey) as scan_run_id,
               cast(count(distinct l_partkey) as int) as file_count, cast(count(*) as int) as class_count,
               cast(sum(l_linenumber) as int) as method_count, 0 as dependency_count
        from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3
        union all
        select l_suppkey * 2 + 1, null, cast(l_shipdate as date), null,
               cast(count(distinct l_partkey) as int), cast(count(*) as int),
               cast(sum(l_linenumber) as int), 0
        from lineitem group by 1, 3""",
    "risk_scores": f"""
        select o_orderkey as id, o_custkey * 2 as repository_id,
               case when {CODE} <> 4 then o_custkey * 20 + {CODE} end as branch_id,
               o_orderkey as scan_run_id, 'module' || (o_orderkey % 100) as module_name,
               cast(floor(o_totalprice / 4000) as int) as score, o_orderdate as generated_at
        from orders""",
    "technical_debt": f"""
        select o_orderkey as id, o_custkey * 2 as repository_id,
               case when {CODE} <> 3 then o_custkey * 20 + {CODE} end as branch_id,
               o_orderkey as scan_run_id, 'module' || (o_orderkey % 100) as module_name,
               o_orderstatus as type, o_orderpriority as severity,
               case when o_orderkey % 500 <> 3 then 'debt of order ' || o_orderkey end as description,
               o_orderdate as created_at
        from orders""",
    # --- source files -----------------------------------------------------------
    "contents": r"""
        select doc_id // 50 * 2 as repository_id, doc_id // 50 * 20 + 1 + doc_id % 50 // 25 as branch_id,
               doc_id as scan_run_id,
               'src/' || source || '/' || doc_id || '.' ||
               (['java', 'js', 'py', 'go'])[doc_id % 4 + 1] as path,
               (['Java', 'JavaScript', 'Python', 'Go'])[doc_id % 4 + 1] as language,
               replace(array_to_string(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x, i:
                   case (doc_id + i - 1) % 8
                   when 0 then 'class ' || coalesce(nullif(regexp_extract(x, '[A-Za-z]+'), ''), 'x') || ' {'
                       || ' // ' || regexp_replace(x, '[^\w ]', ' ', 'g')
                   when 1 then 'public void ' || coalesce(nullif(regexp_extract(x, '[A-Za-z]+'), ''), 'x')
                       || '(int a) { // ' || regexp_replace(x, '[^\w ]', ' ', 'g')
                   when 2 then 'if (' || coalesce(nullif(regexp_extract(x, '[A-Za-z]+'), ''), 'x')
                       || '(x)) { // ' || regexp_replace(x, '[^\w ]', ' ', 'g')
                   when 3 then 'function ' || coalesce(nullif(regexp_extract(x, '[A-Za-z]+'), ''), 'x')
                       || '(a) { // ' || regexp_replace(x, '[^\w ]', ' ', 'g')
                   when 4 then 'const ' || coalesce(nullif(regexp_extract(x, '[A-Za-z]+'), ''), 'x')
                       || ' = (a) => a; // ' || regexp_replace(x, '[^\w ]', ' ', 'g')
                   when 5 then 'def ' || coalesce(nullif(regexp_extract(x, '[A-Za-z]+'), ''), 'x')
                       || '(self): // ' || regexp_replace(x, '[^\w ]', ' ', 'g')
                   when 6 then '// // ' || regexp_replace(x, '[^\w ]', ' ', 'g')
                       || (case doc_id % 3 when 0 then chr(10) when 1 then chr(13) || chr(10)
                           else chr(13) end) || ' ' || chr(9)
                   else '// ' || x end), chr(1)), chr(1),
                   case doc_id % 3 when 0 then chr(10) when 1 then chr(13) || chr(10) else chr(13) end)
               || case when doc_id % 5 <> 0 then ''
                  else case doc_id % 3 when 0 then chr(10) when 1 then chr(13) || chr(10)
                       else chr(13) end end as content
        from documents
        union all
        select page_id // 50 * 2, page_id // 50 * 20 + 3, page_id, 'web/' || page_id || '.js',
               'JavaScript', html from pages""",
    "file_arrays": r"""
        select * exclude (content, ls),
               case when ls[-1] = '' then ls[:-2] else ls end as ls
        from (select *, regexp_split_to_array(content, '\r\n|\r|\n') as ls from contents)""",
    "lines": """
        select repository_id, branch_id, path, language, unnest(ls) as line,
               generate_subscripts(ls, 1) - 1 as line_no
        from file_arrays where len(ls) > 0""",
    "locs": r"""
        select repository_id, branch_id, scan_run_id, path, language,
               cast(len(list_filter(ls, lambda x: regexp_matches(x, '\S'))) as int) as loc
        from file_arrays""",
    "class_hits": f"""
        select repository_id, branch_id, path, raw_name,
               row_number() over (partition by path order by line_no, m) - 1 as seq
        from (select *, unnest(names) as raw_name, generate_subscripts(names, 1) as m
              from (select *, case when language = 'Python' then {_all('line', _PY_CLASS)}
                              else {_all('line', _CLASS)} end as names from lines)
              where len(names) > 0)""",
    "call_hits": f"""
        select repository_id, branch_id, path, raw_name, line_no, m
        from (select *, unnest(names) as raw_name, generate_subscripts(names, 1) as m
              from (select *, case when language = 'Python' then {_all('line', _PY_DEF)}
                              when language = 'JavaScript' then
                                   {_all('line', _FUNCTION)} || {_all('line', _ARROW)} || {_all('line', _JAVA)}
                              else {_all('line', _JAVA)} end as names from lines)
              where len(names) > 0)""",
    "method_hits": f"""
        select repository_id, branch_id, path, raw_name,
               row_number() over (partition by path order by line_no, m) - 1 as seq
        from call_hits where raw_name not in {_KEYWORDS}""",
    "class_names": """
        select *, case when n = 1 then raw_name else raw_name || '#' || n end as name
        from (select *, row_number() over (partition by path, raw_name order by seq) as n
              from class_hits)""",
    "method_names": """
        select *, case when n = 1 then raw_name else raw_name || '#' || n end as name
        from (select *, row_number() over (partition by path, raw_name order by seq) as n
              from method_hits)""",
    "per_file": r"""
        select l.*, coalesce(nc, 0) as nc, coalesce(nm, 0) as nm,
               case when nc > 0 then first_name
                    when nm > 0 then regexp_replace(string_split(l.path, '/')[-1],
                                                    '^(.+)\.[^.]*$', '\1') end as first_class
        from locs l
        left join (select path, count(*) as nc, min_by(raw_name, seq) as first_name
                   from class_hits group by path) c on c.path = l.path
        left join (select path, count(*) as nm from method_hits group by path) m on m.path = l.path""",
    "classes": """
        select f.repository_id, f.branch_id, f.path, c.name, f.loc,
               cast(case when c.seq = 0 then f.nm else 0 end as int) as method_count,
               sha256(f.repository_id || '/' || coalesce(cast(f.branch_id as varchar), '') || '/' || f.path) as file_key
        from class_names c join per_file f on f.path = c.path
        union all
        select repository_id, branch_id, path, first_class, loc, cast(nm as int),
               sha256(repository_id || '/' || coalesce(cast(branch_id as varchar), '') || '/' || path) as file_key
        from per_file where nc = 0 and nm > 0""",
    "methods": """
        select f.repository_id, f.branch_id, f.path, f.first_class as class_name, m.name,
               0 as loc, 0 as complexity,
               sha256(f.repository_id || '/' || coalesce(cast(f.branch_id as varchar), '') || '/' || f.path) as file_key
        from method_names m join per_file f on f.path = m.path""",
    "source_files": """
        select repository_id, branch_id, scan_run_id, path, language, loc,
               sha256(repository_id || '/' || coalesce(cast(branch_id as varchar), '') || '/' || path) as file_key from locs""",
    "totals": """
        select repository_id, branch_id, cast(count(*) as int) as file_count,
               cast(sum(case when nc = 0 and nm > 0 then 1 else nc end) as int) as class_count,
               cast(sum(nm) as int) as method_count
        from per_file group by 1, 2""",
    # --- manifests and listings ---------------------------------------------------
    "manifest": """
        select page_id,
               case page_id % 8 when 0 then url
                    when 1 then 'git@host.example:org/p' || page_id || '.git'
                    when 2 then 'HTTPS://host.example/org/p' || page_id when 3 then '  '
                    when 4 then 'https://host.example/org/p' || page_id || '/'
                    when 5 then 'ftp://host.example/p' || page_id
                    when 6 then ' https://host.example/org/p ' || page_id || '.git '
                    else 'https:///nohost' end as repo_url,
               case page_id % 3 when 0 then '  repo ' || page_id || chr(9) when 1 then '' end as repo_name,
               case when page_id % 5 = 0 then '' else url end as origin_url,
               '/data/my repos/p~' || page_id || '+é' as root_path,
               case when page_id % 4 <> 1 then 'main' end as branch_name,
               md5(url) as head_commit_sha
        from pages""",
    "paths": """
        select doc_id,
               case doc_id % 7 when 0 then 'node_modules/' when 1 then 'src/build/' when 2 then '.github/'
                    when 3 then 'Build/' when 4 then 'src/builder/' else 'src/' end
               || source || '/d' || doc_id || '/' ||
               case doc_id % 11 when 0 then 'Main.java' when 1 then '__init__.py' when 2 then '.eslintrc.js'
                    when 3 then 'py' when 4 then 'a.test.ts' when 5 then 'README.md' when 6 then 'X.KT'
                    when 7 then 'x.hpp' when 8 then '.py' when 9 then 'noext' else 'out' end as path
        from documents""",
    "kept_paths": """
        select * from paths where len(list_intersect(string_split(path, '/'),
            ['.git', '.gradle', '.idea', '.vscode', 'build', 'dist', 'node_modules', 'out', 'target',
             'coverage', '.venv', 'venv', '__pycache__'])) = 0""",
    "branch_lines": """
        select c_custkey,
               case c_custkey % 5 when 0 then '  ' || md5(c_name) || '  refs/heads/' || lower(c_name)
                    when 1 then md5(c_name) || chr(9) || 'refs/heads/feature/' || lower(c_name)
                    when 2 then ' ' when 3 then md5(c_name) || chr(9) || 'refs/tags/v1'
                    else md5(c_name) || chr(9) || 'refs/heads/' || lower(c_name) end as line
        from customer""",
    # --- latest scan and metrics ------------------------------------------------------
    "latest_scan": """
        select repository_id, id, branch_id, head_commit_sha, status, started_at, completed_at
        from scan_runs
        qualify row_number() over (partition by repository_id
                                   order by coalesce(completed_at, started_at) desc, id desc) = 1""",
    "repo_scan": """
        select r.id as repository_id, s.id as scan_run_id, s.branch_id, s.head_commit_sha, s.status,
               s.started_at, s.completed_at
        from repositories r left join latest_scan s on s.repository_id = r.id""",
    "repo_metrics": """
        select s.repository_id, s.branch_id, s.scan_run_id, m.date, m.file_count, m.class_count,
               m.method_count
        from repo_scan s left join repository_metrics m
          on m.repository_id = s.repository_id and m.branch_id is not distinct from s.branch_id
        qualify row_number() over (partition by s.repository_id order by m.date desc nulls last) = 1""",
    "summary": """
        select r.id as repository_id, r.name, r.url, r.updated_at, lb.name as latest_branch,
               s.scan_run_id, s.head_commit_sha, s.status, s.started_at, s.completed_at,
               m.file_count, m.class_count, m.method_count,
               cast(count(distinct b.id) as int) as branch_count
        from repositories r
        left join branches b on b.repository_id = r.id
        join repo_scan s on s.repository_id = r.id
        left join branches lb on lb.id = s.branch_id
        join repo_metrics m on m.repository_id = r.id
        group by all""",
    "newest_scans": """
        select repository_id, branch_id, id, started_at from scan_runs
        qualify row_number() over (partition by repository_id, branch_id
                                   order by started_at desc, id desc) = 1""",
    "delete_ids": """
        select c_custkey * 2 as id from customer where c_acctbal < 0
        union all select min(c_custkey) - 1 from customer""",
    # --- snapshots ---------------------------------------------------------------------
    "snap_base": r"""
        select *, sha256(content) as sha,
               case when ls[-1] = '' then ls[:-2] else ls end as l
        from (select 'src/' || source || '/' || doc_id || '.txt' as path, text as content,
                     regexp_split_to_array(text, '\r\n|\r|\n') as ls from documents)""",
    "snap_head": r"""
        select *, sha256(content) as sha, case when ls[-1] = '' then ls[:-2] else ls end as l
        from (select *, regexp_split_to_array(content, '\r\n|\r|\n') as ls from (
            select case when doc_id % 11 = 0 then 'moved/' || doc_id || '.txt'
                        else 'src/' || source || '/' || doc_id || '.txt' end as path,
                   case when doc_id % 5 = 0 then text || chr(10) || 'extra' else text end as content
            from documents where doc_id not in (select doc_id from labels where toxic = 1)
            union all
            select 'copy/' || doc_id || '.txt', text from documents
            where doc_id in (select doc_id from labels where quality = 1)
            union all select 'web/' || page_id || '.html', html from pages))""",
    "come": """
        select h.path, h.sha, len(h.l) as n, row_number() over (partition by h.sha order by h.path) as r
        from snap_head h where h.path not in (select path from snap_base)""",
    "gone": """
        select b.path, b.sha, len(b.l) as n, row_number() over (partition by b.sha order by b.path) as r
        from snap_base b where b.path not in (select path from snap_head)""",
    "changed": """
        select b.path, b.l as bl, h.l as hl from snap_base b join snap_head h on h.path = b.path
        where h.sha <> b.sha""",
    "changed_lines": """
        select path, sum(case when d > 0 then d else 0 end) as a, sum(case when d < 0 then -d else 0 end) as r
        from (select path, line, sum(s) as d
              from (select path, unnest(hl) as line, 1 as s from changed
                    union all select path, unnest(bl), -1 from changed) group by 1, 2) group by 1""",
    # --- references -----------------------------------------------------------------------
    "definitions": """
        select distinct repository_id, branch_id, path, raw_name as name from class_hits
        union all
        select repository_id, branch_id, path, first_class from per_file where nc = 0 and nm > 0""",
    "tokens": r"""
        select distinct repository_id, branch_id, path, unnest(regexp_extract_all(line,
               '[A-Za-z_$][\w$]*')) as token from lines""",
    "edges": """
        select f.repository_id, f.branch_id, f.path as source_path, f.first_class as source_class,
               t.token as target_class, count(*) as target_files
        from per_file f
        join tokens t on t.path = f.path
        join definitions d on d.repository_id = f.repository_id and d.branch_id = f.branch_id
                          and d.name = t.token and d.path <> f.path
        where f.first_class is not null group by all""",
    "dependencies": """
        select repository_id, branch_id, source_path, source_class, target_class, target_files,
               'reference' as dependency_type,
               sha256(repository_id || '/' || coalesce(cast(branch_id as varchar), '') || '/' || source_path) as file_key from edges""",
    # --- events of the state changes -------------------------------------------------------
    "shipments": f"""
        select o_custkey * 2 as repository_id, o_custkey * 20 + {CODE} as branch_id,
               o_orderkey as commit_id, md5(cast(o_orderkey as varchar)) as sha,
               o_orderpriority as name, 'Part ' || l_partkey as author_name, l_shipdate as event_time,
               l_linenumber * 100000000 + l_partkey * 100 + cast(l_quantity as int) as event_id
        from lineitem join orders on l_orderkey = o_orderkey""",
    "rescanned": """
        select distinct repository_id, branch_id from source_files where path like 'src/%'""",
}

# table -> columns of its key, for readable keys
KEYS = {
    "repositories": "id", "branches": "id", "commits": "id", "branch_commits": "id",
    "scan_runs": "id", "file_changes": "scan_run_id path", "analysis_artifacts": "id",
    "source_files": "repository_id branch_id path", "classes": "repository_id branch_id path name",
    "methods": "repository_id branch_id path class_name name",
    "dependencies": "repository_id branch_id source_path source_class target_class dependency_type",
    "repository_metrics": "repository_id branch_id date", "risk_scores": "id", "technical_debt": "id",
}


def _key(columns: str) -> str:
    parts = ", ".join(f"coalesce(cast({c} as varchar), '')" for c in columns.split())
    return f"concat_ws('|', {parts})"


def _checks() -> str:
    rules = [
        ("commits", "sha_not_blank", "length(trim(sha)) > 0"),
        ("scan_runs", "status_domain",
         "status in ('pending','running','completed','failed','cancelled')"),
        ("scan_runs", "trigger_type_domain", "trigger_type in ('manual','scheduled','webhook')"),
        ("scan_runs", "head_commit_sha_not_blank", "length(trim(head_commit_sha)) > 0"),
        ("scan_runs", "completed_after_started", "completed_at is null or completed_at >= started_at"),
        ("file_changes", "change_type_domain",
         "change_type in ('added','modified','deleted','renamed','copied')"),
        ("file_changes", "additions_not_negative", "additions >= 0"),
        ("file_changes", "deletions_not_negative", "deletions >= 0"),
        ("file_changes", "path_not_blank", "length(trim(path)) > 0"),
        ("analysis_artifacts", "artifact_type_domain",
         "artifact_type in ('llm_context','summary','diff_patch','metrics','risk_report')"),
        ("analysis_artifacts", "format_domain", "format in ('json','markdown','patch','text')"),
        ("analysis_artifacts", "uri_not_blank", "length(trim(uri)) > 0"),
        ("source_files", "loc_not_negative", "loc >= 0"),
        ("source_files", "path_not_blank", "length(trim(path)) > 0"),
        ("classes", "loc_not_negative", "loc >= 0"),
        ("classes", "method_count_not_negative", "method_count >= 0"),
        ("methods", "loc_not_negative", "loc >= 0"),
        ("methods", "complexity_not_negative", "complexity >= 0"),
        ("dependencies", "target_files_positive", "target_files > 0"),
        ("repository_metrics", "file_count_not_negative", "file_count >= 0"),
        ("repository_metrics", "class_count_not_negative", "class_count >= 0"),
        ("repository_metrics", "method_count_not_negative", "method_count >= 0"),
        ("repository_metrics", "dependency_count_not_negative", "dependency_count >= 0"),
        ("risk_scores", "score_range", "score between 0 and 100"),
    ]
    return " union all ".join(
        f"select '{t}' as table_name, '{r}' as rule, {_key(KEYS[t])} as key from {t} "
        f"where not coalesce({p}, true)" for t, r, p in rules)


def _uniques() -> str:
    keys = [
        ("repositories", "url", True), ("branches", "repository_id name", True),
        ("branches", "repository_id id", True), ("commits", "repository_id sha", True),
        ("commits", "repository_id id", True), ("branch_commits", "branch_id commit_id", True),
        ("file_changes", "scan_run_id path", True), ("analysis_artifacts", "uri", True),
        ("source_files", "repository_id branch_id path", False),
        ("source_files", "file_key", True), ("classes", "file_key name", True),
        ("methods", "file_key class_name name", True),
        ("dependencies", "file_key source_class target_class dependency_type", True),
        ("repository_metrics", "repository_id branch_id date", False),
    ]
    parts = []
    for table, key, ignores_nulls in keys:
        columns = key.split()
        where = " and ".join(f"{c} is not null" for c in columns) if ignores_nulls else "true"
        parts.append(
            f"select '{table}' as table_name, 'unique_{'_'.join(columns)}' as rule, {_key(key)} as key, "
            f"cast(count(*) as varchar) as detail from {table} where {where} "
            f"group by {', '.join(columns)} having count(*) > 1")
    return " union all ".join(parts) + " union all " + _ONE_DEFAULT


_ONE_DEFAULT = """
    select 'branches' as table_name, 'unique_repository_id_where_is_default' as rule,
           cast(repository_id as varchar) as key, cast(count(*) as varchar) as detail
    from branches where is_default group by repository_id having count(*) > 1"""


def _references() -> str:
    repo, branch = ("repository_id", "repositories", "id"), (
        "repository_id branch_id", "branches", "repository_id id")
    scan = ("scan_run_id", "scan_runs", "id")
    keys = [("branches", *repo), ("commits", *repo), ("branch_commits", *repo),
            ("branch_commits", *branch),
            ("branch_commits", "repository_id commit_id", "commits", "repository_id id"),
            ("scan_runs", *repo), ("scan_runs", *branch),
            ("scan_runs", "repository_id base_commit_sha", "commits", "repository_id sha"),
            ("scan_runs", "repository_id head_commit_sha", "commits", "repository_id sha"),
            ("file_changes", *scan)]
    for table in ("analysis_artifacts", "source_files", "repository_metrics", "risk_scores",
                  "technical_debt"):
        keys += [(table, *repo), (table, *branch), (table, *scan)]
    keys += [
        ("classes", "file_key", "source_files", "file_key"),
        ("methods", "file_key class_name", "classes", "file_key name"),
        ("dependencies", "file_key source_class", "classes", "file_key name"),
        ("dependencies", "repository_id branch_id target_class", "classes", "repository_id branch_id name"),
    ]
    parts = []
    for table, child, parent, columns in keys:
        pairs = list(zip(child.split(), columns.split()))
        # A file's branch may be null and is part of its key all the same.
        file_key = parent in ("source_files", "classes")
        on = " and ".join(f"p.{b} is not distinct from c.{a}" for a, b in pairs)
        present = " and ".join(f"c.{a} is not null" for a, _ in pairs if not (file_key and a == "branch_id"))
        key = ", ".join(f"c.{a}" for a, _ in pairs)
        parts.append(
            f"select '{table}' as table_name, '{'_'.join(child.split())}_in_{parent}' as rule, "
            f"{_key(' '.join('c.' + a for a, _ in pairs))} as key, cast(count(*) as varchar) as detail from {table} c "
            f"where {present} and not exists (select 1 from {parent} p where {on}) group by {key}")
    return " union all ".join(parts)


def _required() -> str:
    columns = {
        "repositories": "id name url created_at updated_at",
        "branches": "id repository_id name is_default created_at updated_at",
        "commits": "id repository_id sha discovered_at",
        "branch_commits": "id repository_id branch_id commit_id first_seen_at",
        "scan_runs": "id repository_id branch_id head_commit_sha status trigger_type started_at",
        "file_changes": "scan_run_id path change_type additions deletions",
        "analysis_artifacts": "id repository_id artifact_type format uri generated_at",
        "source_files": "repository_id path loc file_key",
        "classes": "repository_id path name loc method_count file_key",
        "methods": "repository_id path class_name name loc complexity file_key",
        "dependencies": "repository_id source_path source_class target_class target_files "
                        "dependency_type file_key",
        "repository_metrics": "repository_id date file_count class_count method_count dependency_count",
        "risk_scores": "id repository_id module_name score generated_at",
        "technical_debt": "id repository_id module_name type severity description created_at",
    }
    manifest = ("(select page_id as id, repo_name as name, repo_url as url, "
                "timestamp '1995-01-01' as created_at, null as updated_at from manifest)")
    return " union all ".join(
        f"select '{t}' as table_name, '{c}_required' as rule, {_key(KEYS[t])} as key "
        f"from {manifest if t == 'repositories' else t} where {c} is null"
        for t, names in columns.items() for c in names.split())


def _domains() -> str:
    rules = [("scan_runs", "status", "'pending','running','completed','failed','cancelled'"),
             ("scan_runs", "trigger_type", "'manual','scheduled','webhook'"),
             ("file_changes", "change_type", "'added','modified','deleted','renamed','copied'"),
             ("analysis_artifacts", "artifact_type",
              "'llm_context','summary','diff_patch','metrics','risk_report'"),
             ("analysis_artifacts", "format", "'json','markdown','patch','text'")]
    return " union all ".join(
        f"select '{t}' as table_name, '{c}_domain' as rule, {c} as key, "
        f"cast(count(*) as varchar) as detail from {t} where {c} not in ({values}) group by {c}"
        for t, c, values in rules)


def _lengths() -> str:
    limits = {
        "repositories": {"name": 17, "url": 50},
        "branches": {"name": 255, "last_seen_commit_sha": 64, "last_scanned_commit_sha": 64},
        "commits": {"sha": 64, "author_name": 255, "author_email": 320, "message": 18},
        "scan_runs": {"base_commit_sha": 64, "head_commit_sha": 64, "status": 50, "trigger_type": 50},
        "file_changes": {"change_type": 50},
        "analysis_artifacts": {"artifact_type": 8, "format": 50, "content_hash": 128},
        "source_files": {"language": 100}, "classes": {"name": 8}, "methods": {"name": 8},
        "dependencies": {"dependency_type": 100}, "risk_scores": {"module_name": 255},
        "technical_debt": {"module_name": 255, "type": 100, "severity": 8},
    }
    return " union all ".join(
        f"select '{t}' as table_name, '{c}_length' as rule, {_key(KEYS[t])} as key, "
        f"cast(length({c}) as varchar) as detail from {t} where length({c}) > {n}"
        for t, columns in limits.items() for c, n in columns.items())


def _cascade() -> str:
    dead = "(select id from delete_ids)"
    dead_scans = f"(select id from scan_runs where repository_id in {dead})"
    rules = {t: f"repository_id not in {dead}" for t in KEYS}
    rules["repositories"] = f"id not in {dead}"
    rules["file_changes"] = f"scan_run_id not in {dead_scans}"
    rules["analysis_artifacts"] += f" and (scan_run_id is null or scan_run_id not in {dead_scans})"
    return " union all ".join(
        f"select '{t}' as table_name, {_key(KEYS[t])} as key from {t} where {rule}"
        for t, rule in rules.items()) + """
        union all select 'unknown_id', cast(id as varchar) from delete_ids
        where id not in (select id from repositories)"""


def _set_null() -> str:
    dead = "(select id from branches where name = '2-HIGH')"
    scans = f"(select id from scan_runs where branch_id in {dead})"
    branch = f"case when branch_id in {dead} then null else branch_id end"
    scan = f"case when scan_run_id in {scans} then null else scan_run_id end"
    nothing = "cast(null as bigint)"
    # table: (rows that stay, branch_id, scan_run_id)
    rules = {t: ("true", nothing, nothing) for t in KEYS}
    rules["branches"] = (f"id not in {dead}", nothing, nothing)
    rules["branch_commits"] = rules["scan_runs"] = (f"branch_id not in {dead}", "branch_id", nothing)
    rules["file_changes"] = (f"scan_run_id not in {scans}", nothing, "scan_run_id")
    rules["analysis_artifacts"] = (f"scan_run_id is null or scan_run_id not in {scans}", branch,
                                   "scan_run_id")
    for t in ("source_files", "repository_metrics", "risk_scores", "technical_debt"):
        rules[t] = ("true", branch, scan)
    for t in ("classes", "methods", "dependencies"):
        rules[t] = ("true", branch, nothing)
    parts = []
    for t, (stays, b, s) in rules.items():
        columns = " ".join(f"@{c}" if c == "branch_id" else c for c in KEYS[t].split())
        key = ", ".join(f"coalesce(cast({branch if c == '@branch_id' else c} as varchar), '')"
                        for c in columns.split())
        parts.append(f"select '{t}' as table_name, concat_ws('|', {key}) as key, "
                     f"{b} as branch_id, {s} as scan_run_id from {t} where {stays}")
    return " union all ".join(parts)


_LAST = "qualify row_number() over (partition by {0} order by event_time desc, event_id desc) = 1"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SUMMARY_COLUMNS = """
    repository_id as id, name, url, branch_count, latest_branch, head_commit_sha as latest_commit_sha,
    scan_run_id as latest_scan_run_id, status as latest_scan_status, completed_at as last_scanned_at,
    coalesce(file_count, 0) as file_count, coalesce(class_count, 0) as class_count,
    coalesce(method_count, 0) as method_count"""
_CATALOGUE = (f"select {_SUMMARY_COLUMNS} from summary order by "
              "coalesce(completed_at, started_at, updated_at) desc, name, repository_id")
_DERIVED = rf"""
    select page_id, repo_url, case when regexp_matches(n, '\S') then n else 'repository' end as name
    from (select page_id, repo_url, regexp_replace(regexp_extract({_STRIP.format('repo_url')},
          '[^/:]*$'), '\.git$', '') as n from manifest)"""
_REPLACED = """
    select * from source_files s where not exists
      (select 1 from rescanned r where r.repository_id = s.repository_id and r.branch_id = s.branch_id)
    union all
    select repository_id, branch_id, scan_run_id, path, language, loc + 1, file_key from source_files s
    where exists (select 1 from rescanned r where r.repository_id = s.repository_id
                  and r.branch_id = s.branch_id)
      and repository_id not in (select id from delete_ids)
      and scan_run_id not in (select doc_id from labels where toxic = 1)"""

_QUERIES: dict[str, str] = {
    "source_tree_scan": """
        select path, cast(strlen(text) as bigint) as size, md5(text) as digest
        from kept_paths join documents using (doc_id)""",
    "skip_generated_dirs": "select * from kept_paths",
    "source_size_cap": """
        select doc_id, cast(strlen(text) as int) as size from documents where strlen(text) <= 2000""",
    "source_decode_lines": "select path, cast(line_no as int) as line_no, line from lines",
    "read_repository_tables": _CATALOGUE,
    "branch_listing_parse": rf"""
        select c_custkey, case when ok then regexp_extract(t, p, 2) end as name,
               case when ok then regexp_extract(t, p, 1) end as commit_sha, ok as is_valid
        from (select c_custkey, t, p, regexp_matches(t, p) as ok
              from (select c_custkey, {_STRIP.format('line')} as t,
                           '^(\S+)\s+refs/heads/(.*)$' as p
                    from branch_lines where regexp_matches(line, '\S')))""",
    "commit_metadata_load": """
        select page_id, coalesce(branch_name, 'HEAD') as branch_name, head_commit_sha,
               case page_id % 2 when 0 then timestamp '2026-01-02 01:04:05'
               else timestamp '2026-01-02 03:04:05' end as committed_at,
               case when page_id % 6 <> 2 then 'Author ' || page_id % 9 end as author_name,
               case when page_id % 4 <> 0 then 'a' || page_id % 9 || '@example.org' end as author_email,
               'change of ' || url || chr(10) || ' ' as message, cast(null as varchar) as problem
        from manifest join pages using (page_id)""",
    "write_scan_snapshot": _REPLACED,
    "read_scan_version": f"""
        select repository_id, branch_id, cast(1 as bigint) as version, count(*) as n_files,
               cast(sum(loc) as bigint) as loc from source_files group by 1, 2
        union all
        select repository_id, branch_id, 2, count(*), cast(sum(loc) as bigint) from ({_REPLACED}) group by 1, 2""",
    "detect_language": r"""
        select * from (select doc_id, path,
            case when e = 'java' then 'Java' when e in ('kt', 'kts') then 'Kotlin'
                 when e in ('js', 'jsx', 'mjs', 'cjs') then 'JavaScript'
                 when e in ('ts', 'tsx') then 'TypeScript' when e = 'py' then 'Python'
                 when e = 'go' then 'Go' when e = 'rb' then 'Ruby' when e = 'php' then 'PHP'
                 when e = 'cs' then 'C#' when e in ('cpp', 'cc', 'cxx', 'hpp', 'h', 'c') then 'C/C++'
                 when e = 'rs' then 'Rust' when e = 'swift' then 'Swift' end as language
            from (select *, lower(string_split(string_split(path, '/')[-1], '.')[-1]) as e from paths))
        where language is not null""",
    "control_keyword_filter": f"""
        select f.path, cast(count(h.raw_name) filter (where h.raw_name not in {_KEYWORDS}) as int) as kept,
               cast(count(h.raw_name) as int) as matches
        from locs f left join call_hits h on h.path = f.path group by f.path""",
    "repo_url_validation": rf"""
        select page_id, repo_url, reason is null as is_valid, reason
        from (select page_id, repo_url,
                case when not regexp_matches(repo_url, '\S') then 'required'
                     when starts_with(u, 'git@') then null
                     when regexp_matches(u, '\s') then 'invalid'
                     when regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)
                          not in ('https', 'http', 'ssh') then 'scheme'
                     when regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) = '' then 'host' end as reason
              from (select *, {_STRIP.format('repo_url')} as u from manifest))""",
    "null_safe_match": """
        select s.repository_id, s.branch_id, count(*) as days
        from repo_scan s join repository_metrics m
          on m.repository_id = s.repository_id and m.branch_id is not distinct from s.branch_id
        group by 1, 2""",
    "summary_projection": f"select {_SUMMARY_COLUMNS} from summary",
    "scan_runs_by_status": f"""
        select id, repository_id, status, started_at from scan_runs
        where status in ('completed', 'running') and started_at >= {CUT}""",
    "first_non_blank": rf"""
        select page_id, case when regexp_matches(repo_name, '\S') then {_STRIP.format('repo_name')}
               else repo_url end as name from manifest""",
    "derive_repository_name": f"select page_id, name from ({_DERIVED})",
    "safe_path_segment": """
        select page_id, regexp_replace(root_path, '[^A-Za-z0-9._-]', '-', 'g') as segment from manifest""",
    "repository_key": f"""
        select page_id, regexp_replace(name, '[^A-Za-z0-9._-]', '-', 'g') || '-' ||
               left(sha256(repo_url), 12) as key from ({_DERIVED})""",
    "line_has_text": r"""
        select path, cast(line_no as int) as line_no, regexp_matches(line, '\S') as has_text from lines""",
    "fallback_class_name": r"""
        select doc_id, regexp_replace(string_split(path, '/')[-1], '^(.+)\.[^.]*$', '\1') as class_name
        from paths""",
    "relative_path": "select doc_id, path from paths",
    "canonical_repository_url": rf"""
        select page_id, case when regexp_matches(repo_url, '\S') then {_STRIP.format('repo_url')}
               when regexp_matches(origin_url, '\S') then origin_url
               else 'file:///data/my%20repos/p~' || page_id || '+%C3%A9/' end as url from manifest""",
    "timestamp_cast": """
        select page_id, case page_id % 2 when 0 then timestamp '2026-01-02 01:04:05'
               else timestamp '2026-01-02 03:04:05' end as committed_at from manifest""",
    "short_commit": "select id, left(head_commit_sha, 12) as short_sha from scan_runs",
    "extract_classes": "select path, cast(seq as int) as seq, raw_name from class_hits",
    "extract_methods": "select path, cast(seq as int) as seq, raw_name from method_hits",
    "unique_symbol_names": """
        select path, 'class' as kind, cast(seq as int) as seq, name from class_names
        union all select path, 'method', cast(seq as int), name from method_names""",
    "attach_methods_to_class": """
        select repository_id, branch_id, path, class_name, name from methods""",
    "class_rows": "select * from classes",
    "flatten_parse_tree": """
        select 'file' as kind, path, cast(null as varchar) as parent, language as name, loc, 0 as n
        from source_files
        union all select 'class', path, null, name, loc, method_count from classes
        union all select 'method', path, class_name, name, loc, complexity from methods""",
    "join_repo_branches": """
        select r.id, r.url, b.id as branch_id, b.name as branch_name
        from repositories r left join branches b on b.repository_id = r.id""",
    "latest_scan_per_repo": "select * from repo_scan",
    "latest_metrics_per_repo": """
        select repository_id, branch_id, scan_run_id, cast(date as varchar) as date, file_count,
               class_count, method_count from repo_metrics""",
    "latest_branch_name": """
        select s.repository_id, s.scan_run_id, s.branch_id, b.name as latest_branch
        from repo_scan s left join branches b on b.id = s.branch_id""",
    "default_branch_flag": f"""
        select repository_id, name, created_at as first_seen_at,
               row_number() over (partition by repository_id order by created_at, name) = 1
               and not exists (select 1 from branches d where d.repository_id = b.repository_id
                               and d.is_default and d.created_at < {CUT}) as is_default
        from branches b where created_at >= {CUT}""",
    "file_class_method_join": """
        select f.repository_id, f.branch_id, f.path, f.language, c.name as class_name,
               m.name as method_name
        from source_files f join classes c using (path)
        join methods m on m.path = f.path and m.class_name = c.name""",
    "orphan_rows": """
        select id, repository_id, branch_id from scan_runs
        where repository_id in (select id from delete_ids)""",
    "branch_count": """
        select r.id, cast(count(distinct b.id) as int) as branch_count
        from repositories r left join branches b on b.repository_id = r.id group by r.id""",
    "repository_summary_grouping": "select * from summary",
    "file_loc": "select repository_id, branch_id, path, loc from locs",
    "scan_totals": "select * from totals",
    "daily_repository_metrics": """
        select s.repository_id, s.branch_id, s.id as scan_run_id,
               cast(cast(s.started_at as date) as varchar) as date,
               coalesce(file_count, 0) as file_count, coalesce(class_count, 0) as class_count,
               coalesce(method_count, 0) as method_count, 0 as dependency_count
        from newest_scans s left join totals t
          on t.repository_id = s.repository_id and t.branch_id = s.branch_id""",
    "text_length_check": _lengths(),
    "list_repositories": _CATALOGUE,
    "top1_per_group": "select * from newest_scans",
    "upsert_repositories": f"""
        with events as (
            select o_custkey * 2 as id, o_orderdate as event_time, o_orderkey as event_id,
                   o_orderpriority as tag from orders
            union all
            select l_suppkey * 2 + 1, l_shipdate, l_orderkey * 1000 + l_linenumber, l_returnflag
            from lineitem),
        last as (select id, event_time, max(tag) as tag from (
                     select * from events
                     qualify rank() over (partition by id order by event_time desc, event_id desc) = 1)
                 group by id, event_time),
        first as (select id, min(event_time) as created_at from events group by id),
        stored as (select * from repositories where id % 2 = 0)
        select r.url, case when l.id is null then r.name else r.name || '-' || l.tag end as name,
               case when s.id is null then first.created_at else s.created_at end as created_at,
               coalesce(l.event_time, s.updated_at) as updated_at
        from repositories r left join last l on l.id = r.id left join first on first.id = r.id
        left join stored s on s.id = r.id
        where l.id is not null or s.id is not null""",
    "upsert_commits": f"""
        select l.repository_id, l.sha, l.author_name, lower(l.name) || '@example.org' as author_email,
               'shipment ' || l.event_id as message, l.event_time as committed_at,
               f.discovered_at
        from (select * from shipments {_LAST.format('repository_id, sha')}) l
        join (select repository_id, sha, min(event_time) as discovered_at
              from shipments group by 1, 2) f
          on f.repository_id = l.repository_id and f.sha = l.sha""",
    "upsert_branches": f"""
        with events as (
            select o_custkey * 2 as repository_id, o_orderpriority as name,
                   md5(cast(o_orderkey as varchar)) as sha, o_orderdate as event_time,
                   o_orderkey as event_id from orders),
        seen as (select repository_id, name, min(event_time) as created_at from events group by 1, 2),
        last as (select * from events {_LAST.format('repository_id, name')})
        select s.repository_id, s.name,
               row_number() over (partition by s.repository_id order by s.created_at, s.name) = 1
               as is_default,
               l.sha as last_seen_commit_sha, l.sha as last_scanned_commit_sha, s.created_at,
               l.event_time as updated_at
        from seen s join last l on l.repository_id = s.repository_id and l.name = s.name""",
    "link_branch_commits": """
        select repository_id, branch_id, commit_id, min(event_time) as first_seen_at
        from shipments group by 1, 2, 3""",
    "upsert_daily_metrics": """
        with m as (
            select l_suppkey * 2 + 1 as repository_id, cast(null as bigint) as branch_id,
                   cast(cast(l_shipdate as date) as varchar) as date, cast(null as bigint) as scan_run_id,
                   l_linestatus, cast(count(distinct l_partkey) as int) as file_count,
                   cast(count(*) as int) as class_count, cast(sum(l_linenumber) as int) as method_count,
                   0 as dependency_count
            from lineitem group by 1, 3, 5)
        select * exclude (l_linestatus) from m
        qualify row_number() over (partition by repository_id, date
                                   order by l_linestatus = 'O' desc) = 1""",
    "replace_branch_files": _REPLACED,
    "complete_scan_runs": f"""
        select o_orderkey as id, o_custkey * 2 as repository_id, o_custkey * 20 + {CODE} as branch_id,
               cast(null as varchar) as base_commit_sha, md5(cast(o_orderkey as varchar))
               as head_commit_sha,
               case when l.l_orderkey is null then 'running' when l.error_message is null
                    then 'completed' else 'failed' end as status,
               'manual' as trigger_type, o_orderdate as started_at, l.completed_at, l.error_message
        from orders left join (
            select * from (select l_orderkey, l_shipdate as completed_at,
                   case when l_returnflag = 'R' then 'line ' || l_linenumber || ' returned' end
                   as error_message from lineitem)
            qualify row_number() over (partition by l_orderkey
                order by completed_at desc, error_message desc nulls last) = 1) l
          on l.l_orderkey = o_orderkey""",
    "delete_repository_cascade": _cascade(),
    "delete_branch_set_null": _set_null(),
    "check_constraints": _checks(),
    "unique_violations": _uniques(),
    "one_default_branch": _ONE_DEFAULT,
    "foreign_key_violations": _references(),
    "not_null_violations": _required(),
    "domain_violations": _domains(),
    "snapshot_file_changes": """
        with pairs as (select c.path, g.path as old_path from come c join gone g
                       on g.sha = c.sha and g.r = c.r),
        smallest as (select sha, min(path) as old_path from snap_base group by sha)
        select c.path, cast(null as varchar) as old_path, 'modified' as change_type,
               cast(coalesce(a, 0) as int) as additions, cast(coalesce(r, 0) as int) as deletions
        from changed c left join changed_lines l on l.path = c.path
        union all select path, old_path, 'renamed', 0, 0 from pairs
        union all
        select c.path, s.old_path, case when s.sha is null then 'added' else 'copied' end,
               case when s.sha is null then cast(c.n as int) else 0 end, 0
        from come c left join smallest s on s.sha = c.sha
        where c.path not in (select path from pairs)
        union all
        select path, null, 'deleted', 0, cast(n as int) from gone
        where path not in (select old_path from pairs)""",
    "incremental_scan": r"""
        with d as (select doc_id, doc_id // 50 as k, coalesce(text, '') as text, source || '/' || doc_id || '.'
                          || ['java', 'js', 'py', 'go'][doc_id % 4 + 1] as name from documents),
        b as (select *, sha256(content) as sha, case when ls[-1] = '' then ls[:-2] else ls end as l
              from (select k, 'src/' || name as path, text as content,
                           regexp_split_to_array(text, '
|
|
') as ls from d where strlen(text) <= 1000000)),
        h as (select *, sha256(content) as sha, case when ls[-1] = '' then ls[:-2] else ls end as l
              from (select *, regexp_split_to_array(content, '
|
|
') as ls from (
                  select k, case when doc_id % 11 = 0 then 'moved/' else 'src/' end || name as path,
                         case when doc_id % 5 = 0 then text || chr(10) || 'extra' else text end as content
                  from d where doc_id not in (select doc_id from labels where toxic = 1)))
              where strlen(content) <= 1000000),
        new as (select *, len(l) as n, row_number() over (partition by k, sha order by path) as r
                from h where not exists (select 1 from b where b.k = h.k and b.path = h.path)),
        old as (select *, len(l) as n, row_number() over (partition by k, sha order by path) as r
                from b where not exists (select 1 from h where h.k = b.k and h.path = b.path)),
        pairs as (select n.k, n.path, o.path as old_path from new n join old o on o.k = n.k and o.sha = n.sha and o.r = n.r),
        smallest as (select k, sha, min(path) as old_path from b group by 1, 2),
        grown as (select b.k, b.path, b.l as bl, h.l as hl from b join h on h.k = b.k and h.path = b.path where h.sha <> b.sha),
        counted as (select k, path, sum(case when d > 0 then d else 0 end) as a, sum(case when d < 0 then -d else 0 end) as r
                    from (select k, path, line, sum(s) as d
                          from (select k, path, unnest(hl) as line, 1 as s from grown
                                union all select k, path, unnest(bl), -1 from grown) group by 1, 2, 3) group by 1, 2),
        changes as (
            select g.k, g.path, cast(null as varchar) as old_path, 'modified' as change_type,
                   cast(coalesce(a, 0) as int) as additions, cast(coalesce(r, 0) as int) as deletions
            from grown g left join counted c on c.k = g.k and c.path = g.path
            union all select k, path, old_path, 'renamed', 0, 0 from pairs
            union all
            select n.k, n.path, s.old_path, case when s.sha is null then 'added' else 'copied' end,
                   case when s.sha is null then cast(n.n as int) else 0 end, 0
            from new n left join smallest s on s.k = n.k and s.sha = n.sha
            where not exists (select 1 from pairs p where p.k = n.k and p.path = n.path)
            union all
            select k, path, null, 'deleted', 0, cast(n as int) from old o
            where not exists (select 1 from pairs p where p.k = o.k and p.old_path = o.path)),
        parsed as (select h.k, count(*) as n from h left join b on b.k = h.k and b.path = h.path and b.sha = h.sha
                   where b.k is null group by 1),
        scanned as (select k, count(*) as n from h group by 1)
        select cast(c.k as varchar) as tree, path, old_path, change_type, additions, deletions,
               md5('/trees/' || c.k || '1') as base_commit_sha, md5('/trees/' || c.k || '2') as head_commit_sha,
               case when s.n is not null then cast(coalesce(p.n, 0) as int) end as parsed_files
        from changes c left join parsed p on p.k = c.k left join scanned s on s.k = c.k""",
    "scan_state_stream": """
        with e as (select o_orderkey as id, o_custkey as c, 'https://git.example/r' || o_custkey || '.git' as url,
                          'r' || o_custkey || ' ' || o_orderstatus as name, o_orderpriority as branch,
                          md5(o_custkey || '/' || year(o_orderdate)) as sha, o_orderdate as t,
                          o_orderkey % 13 = 0 as bad from orders),
        r as (select c, url, name from e qualify row_number() over (partition by c order by t desc, id desc) = 1),
        b as (select c, branch, sha from e qualify row_number() over (partition by c, branch order by t desc, id desc) = 1),
        a as (select c, branch, min(t) as first_scan, max(t) as last_scan, count(*) as n_scans,
                     count_if(bad) as n_failed, count(distinct sha) as n_commits from e group by 1, 2),
        f as (select c, branch, id, id % 4 + 1 as n_files, (id % 4) * (id % 4 + 1) // 2 + (id % 4 + 1) * (id % 10) as loc
              from e where not bad qualify row_number() over (partition by c, branch order by t desc, id desc) = 1),
        m as (select c, branch, count(*) as n_days, sum(id % 4 + 1) as day_files
              from (select * from e where not bad
                    qualify row_number() over (partition by c, branch, cast(t as date) order by t desc, id desc) = 1)
              group by 1, 2)
        select r.url, r.name, a.branch, row_number() over (partition by a.c order by first_scan, a.branch) = 1 as is_default,
               b.sha as head_commit_sha, first_scan, last_scan, n_commits, n_scans, cast(n_failed as bigint) as n_failed,
               coalesce(n_files, 0) as n_files, cast(coalesce(loc, 0) as bigint) as loc, f.id as files_of,
               coalesce(n_days, 0) as n_days, cast(coalesce(day_files, 0) as bigint) as day_files
        from a join r on r.c = a.c join b on b.c = a.c and b.branch = a.branch
        left join f on f.c = a.c and f.branch = a.branch left join m on m.c = a.c and m.branch = a.branch""",
    "class_dependencies": "select * from edges",
    "dependency_counts": """
        select repository_id, branch_id, cast(sum(target_files) as bigint) as dependency_count
        from edges group by 1, 2""",
    "semantic_topk": """
        with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 20 = 0)
        select query_id, cast(rank as int) as rank, vec_id
        from (select q.query_id, e.vec_id, row_number() over (partition by q.query_id
                     order by list_cosine_similarity(e.embedding::double[], q.v) desc, e.vec_id) as rank
              from q, embeddings e) where rank <= 5""",
    "symbol_search": """
        select repository_id, branch_id, path, 'class' as kind, name from classes
        where starts_with(name, 'Th')
        union all
        select repository_id, branch_id, path, 'method', name from methods where starts_with(name, 'Th')""",
    "incremental_scan_stream": """
        select event_id as scan_run_id, user_id as repository_id,
               md5(cast(event_id as varchar)) as head_commit_sha,
               case event_type when 'error' then 'failed' else 'completed' end as status,
               case event_type when 'click' then 'webhook' when 'view' then 'scheduled'
               else 'manual' end as trigger_type, ts as started_at
        from events
        qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
    "daily_scan_counts_stream": """
        select cast(cast(ts as date) as varchar) as day,
               case event_type when 'click' then 'webhook' when 'view' then 'scheduled'
               else 'manual' end as trigger_type, count(*) as scans
        from events
        where cast(ts as date) + interval 1 day <= (select max(ts) - interval 1 day from events)
        group by 1, 2""",
}


def _with_views(sql: str) -> str:
    """Puts the views a query names, and those they name, in front as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(?:from|join|,)\s+{name}\b", text):
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    ctes = ", ".join(f"{name} as ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    if not ctes:
        return body
    if body.startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"


ORACLE: dict[str, str] = {name: _with_views(sql) for name, sql in _QUERIES.items()}
