"""Sub-queries shared by the SQL twins: the same semantics in set-based SQL, written apart from the operators."""

from __future__ import annotations

from winnow import fixed
from winnow.catalog.fixture import AS_OF_YEAR, JOBS_SQL, RESUMES_SQL
from winnow.catalog.registry import part, sql_list, sql_text
from winnow.functions import sections as sec

NL = "chr(10)"
CERTIFICATE_SQL = sql_text("(?:" + "|".join(fixed.CERTIFICATE_KEYWORDS) + ")" + fixed.CERTIFICATE_REST)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def blank(x: str) -> str:
    return f"(NOT regexp_matches({x}, '\\S'))"


def found(x: str, pattern: str, flags: str = "") -> str:
    option = f", '{flags}'" if flags else ""
    return f"regexp_matches({x}, {sql_text(pattern)}{option})"


def _first(line: str, patterns: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {found(line, p, 'i')} THEN '{s}'" for s, p in patterns.items())
    return f"(CASE {whens} END)"


def standalone(line: str) -> str:
    return _first(line, {s: sec.standalone_pattern(s) for s in fixed.STANDALONE_HEADINGS})


def inline(line: str) -> str:
    return _first(line, {s: sec.inline_pattern(s) for s in fixed.INLINE_HEADINGS})


def range_years(text: str) -> str:
    """Sum of the year ranges in a lower-cased text."""
    pattern = sql_text(fixed.YEAR_RANGE)
    starts, ends = (f"regexp_extract_all({text}, {pattern}, {g})" for g in (1, 2))
    return f"""coalesce(list_sum(list_transform(range(1, len({starts}) + 1), lambda i: greatest(0,
        (CASE WHEN {ends}[i] IN {sql_list(fixed.OPEN_ENDS)} THEN {AS_OF_YEAR} ELSE TRY_CAST({ends}[i] AS INTEGER) END)
        - CAST({starts}[i] AS INTEGER)))), 0)"""


def stated(text: str, pattern: str) -> str:
    digits = f"regexp_extract({text}, {sql_text(pattern)}, 1)"
    return (f"(CASE WHEN {digits} <> '' THEN least(coalesce(TRY_CAST({digits} AS BIGINT), 25), "
            f"25) END)")


def degree(text: str) -> str:
    levels = ", ".join(f"(CASE WHEN {found(f'lower({text})', p)} THEN CAST({s} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
                       for _, s, p in fixed.DEGREES)
    return f"greatest({levels})"


def words(text: str) -> str:
    return (f"list_filter(list_distinct(regexp_extract_all(lower({text}), {sql_text(fixed.FIELD_WORD)})), "
            f"lambda w: w NOT IN {sql_list(fixed.FIELD_STOP_WORDS)})")


def python_round(x: str, digits: int) -> str:
    """Half-even rounding on the exact binary value, as the engine defines it."""
    s = f"CAST({10 ** digits} AS DOUBLE)"
    n = f"round_even({x} * {s}, 0)"
    high = f"({x} * CAST(134217729 AS DOUBLE) - ({x} * CAST(134217729 AS DOUBLE) - {x}))"
    over = f"({high} * {s} - {n})"
    rest = f"(({x} - {high}) * {s})"
    above = f"(({over} - CAST(0.5 AS DOUBLE)) + {rest})"
    below = f"(({over} + CAST(0.5 AS DOUBLE)) + {rest})"
    odd = f"(abs({n} % 2) = 1)"
    return (f"((CASE WHEN {above} > 0 OR ({above} = 0 AND {odd}) THEN {n} + 1 "
            f"WHEN {below} < 0 OR ({below} = 0 AND {odd}) THEN {n} - 1 ELSE {n} END) / {s})")


# --- inputs ---------------------------------------------------------------------------------------------------------

part("resumes", RESUMES_SQL)
part("jobs", JOBS_SQL)
part("vocab", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {sql_text(t)})" for i, t in enumerate(fixed.SKILLS, 1)) + ") AS v(ord, skill)")
part("roles", "SELECT * FROM (VALUES " + ", ".join(
    f"({100 * p + i}, {sql_text(phrase)}, {sql_text(s)})"
    for p, (phrase, skills) in enumerate(fixed.ROLE_SKILLS.items(), 1) for i, s in enumerate(skills)
) + ") AS r(ord, phrase, skill)")
part("docs", """
SELECT source AS batch_id, doc_id AS resume_id, doc_id AS ordinal, text AS raw_text FROM documents""")

# --- lines and sections -----------------------------------------------------------------------------------------------

part("all_lines", f"""
SELECT batch_id, resume_id, unnest(range(len(l))) AS pos, unnest(l) AS line
FROM (SELECT batch_id, resume_id, string_split(raw_text, {NL}) AS l FROM resumes)""")
part("marked", f"""
SELECT *, {standalone('line')} AS alone,
       (CASE WHEN {standalone('line')} IS NULL THEN {inline('line')} END) AS inlined
FROM all_lines""")
part("filled", f"""
SELECT batch_id, resume_id, pos, line, alone, inlined, coalesce(alone, inlined) AS heading,
       coalesce(last_value(coalesce(alone, inlined) IGNORE NULLS) OVER (
           PARTITION BY resume_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'other') AS section,
       (CASE WHEN alone IS NOT NULL THEN NULL
             WHEN inlined IS NOT NULL THEN {strip("substring(line, instr(line, ':') + 1)")}
             ELSE line END) AS content
FROM marked""")
_texts = ",\n       ".join(
    f"coalesce(string_agg(content, {NL} ORDER BY pos) FILTER (section = '{s}'), '') AS {s}_text"
    for s in fixed.SECTIONS)
part("sectioned", f"""
SELECT batch_id, resume_id, bool_or(heading IS NOT NULL) AS sections_found,
       {_texts}
FROM filled GROUP BY batch_id, resume_id""")
part("parsed", f"""
SELECT r.*, s.* EXCLUDE (batch_id, resume_id),
       s.sections_found AND NOT {blank('s.work_text')} AS has_work,
       s.sections_found AND NOT {blank('s.projects_text')} AS has_projects,
       (CASE WHEN {blank('s.education_text')} THEN r.raw_text ELSE s.education_text END) AS education_source
FROM resumes r JOIN sectioned s USING (resume_id)""")

# --- experience --------------------------------------------------------------------------------------------------------

part("windows", f"""
SELECT resume_id, pos, lower(line) AS line,
       string_agg(lower(line), ' ') OVER (PARTITION BY resume_id ORDER BY pos
           ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS context
FROM all_lines""")
part("dated", f"""
SELECT resume_id, pos, line, context,
       {found('context', fixed.EDUCATION_CONTEXT)} AS education,
       {found('context', fixed.PROJECT_CONTEXT)} AS project,
       {found('context', fixed.WORK_CONTEXT)} AS work,
       {found('context', fixed.COMPANY_TOKEN)} AS company
FROM windows WHERE {found('line', fixed.YEAR_RANGE)}""")
part("dated_sums", f"""
SELECT resume_id, sum(years) FILTER (NOT education AND NOT project) AS years,
       bool_or(NOT education AND NOT project AND (work OR company)) AS works
FROM (SELECT *, {range_years('line')} AS years FROM dated) GROUP BY resume_id""")
part("experience", f"""
SELECT p.resume_id, p.has_work,
       CAST({stated('lower(p.work_text)', fixed.WORK_SECTION_YEARS)} AS BIGINT) AS stated_work,
       CAST(least({range_years('lower(p.work_text)')}, 25) AS BIGINT) AS ranges_work,
       CAST({stated('lower(p.raw_text)', fixed.FREE_TEXT_YEARS)} AS BIGINT) AS stated_free,
       CAST(least(coalesce(d.years, 0), 25) AS BIGINT) AS ranges_free,
       CAST((CASE WHEN p.has_work
             THEN {found('lower(p.work_text)', fixed.WORK_KEYWORD)} OR {found('lower(p.work_text)', fixed.YEAR_RANGE)}
             ELSE coalesce(d.works, FALSE) OR {found('lower(p.raw_text)', fixed.FREE_TEXT_YEARS)}
                  OR {found('lower(p.raw_text)', fixed.EMPLOYMENT_PHRASE)} END) AS BIGINT) AS has_experience
FROM parsed p LEFT JOIN dated_sums d USING (resume_id)""")
part("years", """
SELECT resume_id, has_experience, (CASE WHEN has_work THEN coalesce(stated_work, ranges_work)
       ELSE coalesce(stated_free, ranges_free) END) AS experience_years
FROM experience""")

# --- certificates, contact, education -------------------------------------------------------------------------------------

part("mentions", f"""
SELECT resume_id, n, mention FROM (
  SELECT resume_id, unnest(range(len(m))) AS n, {strip('unnest(m)')} AS mention
  FROM (SELECT resume_id, regexp_extract_all(lower(raw_text), {CERTIFICATE_SQL}) AS m FROM resumes))
WHERE length(mention) > {fixed.MIN_CERTIFICATE_CHARS}""")
part("certificate_rows", f"""
SELECT resume_id, n, mention FROM mentions
UNION ALL
SELECT resume_id, 1000000 + min(pos) AS n, mention FROM (
  SELECT resume_id, pos, {strip('lower(content)')} AS mention FROM filled
  WHERE section = 'certificates' AND content IS NOT NULL) c
WHERE length(mention) > {fixed.MIN_CERTIFICATE_CHARS}
  AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.resume_id = c.resume_id AND m.mention = c.mention)
GROUP BY resume_id, mention""")
part("contacts", f"""
SELECT batch_id, resume_id, CAST({found('lower(raw_text)', fixed.EMAIL)} OR {found('lower(raw_text)', fixed.PHONE)}
       OR contains(lower(raw_text), '{fixed.LINKEDIN}') AS BIGINT) AS has_contact
FROM resumes""")
part("education", f"""
SELECT p.batch_id, p.resume_id, {degree('p.education_source')} AS degree_score,
       len(list_intersect({words('p.education_source')}, {words('j.job_description')})) AS shared_words
FROM parsed p JOIN jobs j USING (batch_id)""")
part("education_scores", """
SELECT batch_id, resume_id, degree_score,
       (CASE WHEN shared_words >= 2 THEN CAST(0.2 AS DOUBLE) WHEN shared_words = 1 THEN CAST(0.1 AS DOUBLE)
        ELSE CAST(0 AS DOUBLE) END) AS field_bonus,
       least(degree_score + (CASE WHEN shared_words >= 2 THEN CAST(0.2 AS DOUBLE)
                             WHEN shared_words = 1 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END),
             CAST(1 AS DOUBLE)) AS education_quality
FROM education""")


def title_case(name: str) -> str:
    runs = f"regexp_extract_all({name}, '[A-Za-z]+|[^A-Za-z]+')"
    return (f"coalesce(list_aggregate(list_transform({runs}, lambda r: upper(r[1:1]) || lower(r[2:])), "
            f"'string_agg', ''), '')")


def person(filename: str) -> str:
    stem = f"regexp_replace({filename}, '^(\\.*[^.].*)\\.[^.]*$', '\\1')"
    bare = f"regexp_replace({stem}, '_?(?:resume|cv)|[0-9]+', '', 'gi')"
    spaced = strip(f"regexp_replace(translate({bare}, '_-', '  '), '\\s+', ' ', 'g')")
    title = title_case(spaced)
    return f"(CASE WHEN {title} = '' THEN {filename} ELSE {title} END)"


part("names", f"SELECT resume_id, filename, {person('filename')} AS name FROM resumes")

# --- projects -------------------------------------------------------------------------------------------------------------

part("project_lines", """
SELECT resume_id, content AS line, row_number() OVER (PARTITION BY resume_id ORDER BY pos) AS n
FROM filled WHERE section = 'projects' AND content IS NOT NULL""")
_small = sql_list(fixed.TITLE_SMALL_WORDS)
part("project_flags", f"""
SELECT *, (CASE WHEN is_blank THEN FALSE ELSE
         {found('stripped', fixed.PROJECT_BULLET, 'i')} OR {found('stripped', fixed.PROJECT_YEAR_RANGE, 'i')}
         OR (length(stripped) < {fixed.TITLE_MAX_CHARS} AND after_gap AND len(words) >= 2
             AND len(list_filter(words, lambda w: lower(w) IN {_small} OR regexp_matches(w, '^\\p{{Lu}}')))
                 >= len(words) * CAST({fixed.TITLE_MIN_SHARE} AS DOUBLE)) END) AS starts
FROM (SELECT *, {strip('line')} AS stripped, {blank('line')} AS is_blank,
             coalesce(lag({blank('line')}) OVER (PARTITION BY resume_id ORDER BY n), TRUE) AS after_gap,
             string_split_regex({strip('line')}, '\\s+') AS words
      FROM project_lines)""")
part("project_segments", f"""
SELECT resume_id, segment, string_agg(line, {NL} ORDER BY n) AS project FROM (
  SELECT *, sum(CASE WHEN NOT is_blank AND (starts OR after_gap) THEN 1 ELSE 0 END)
            OVER (PARTITION BY resume_id ORDER BY n) AS segment
  FROM project_flags)
WHERE NOT is_blank GROUP BY resume_id, segment""")
part("project_split", f"""
SELECT resume_id, segment, project FROM project_segments
WHERE length({strip('project')}) > {fixed.MIN_PROJECT_CHARS}""")
part("full_lines", f"""
SELECT resume_id, line, row_number() OVER (PARTITION BY resume_id ORDER BY n) AS n
FROM project_lines WHERE NOT {blank('line')}""")
part("chunk_walk", f"""
SELECT resume_id, n, line, length(line) AS run, 1 AS chunk FROM full_lines WHERE n = 1
UNION ALL
SELECT f.resume_id, f.n, f.line,
       (CASE WHEN w.run > {fixed.PROJECT_CHUNK_CHARS} THEN 0 ELSE w.run END) + length(f.line),
       w.chunk + (CASE WHEN w.run > {fixed.PROJECT_CHUNK_CHARS} THEN 1 ELSE 0 END)
FROM chunk_walk w JOIN full_lines f ON f.resume_id = w.resume_id AND f.n = w.n + 1""")
part("project_chunks", f"""
SELECT resume_id, chunk, string_agg(line, {NL} ORDER BY n) AS project FROM chunk_walk GROUP BY resume_id, chunk""")
part("project_branch", f"""
SELECT p.resume_id, p.projects_text, p.has_projects,
       (CASE WHEN NOT p.has_projects THEN 'blocks'
             WHEN coalesce(c.n, 0) <= 1 AND length({strip('p.projects_text')}) > {fixed.PROJECT_CHUNK_CHARS} THEN 'chunks'
             WHEN coalesce(c.n, 0) = 0 AND length({strip('p.projects_text')}) > {fixed.MIN_PROJECT_CHARS} THEN 'whole'
             ELSE 'split' END) AS branch
FROM parsed p LEFT JOIN (SELECT resume_id, count(*) AS n FROM project_split GROUP BY resume_id) c USING (resume_id)""")
part("block_lines", f"""
SELECT *, last_value(event IGNORE NULLS) OVER w AS state, sum(CASE WHEN event = 1 THEN 1 ELSE 0 END) OVER w AS block
FROM (SELECT resume_id, pos, line, (CASE WHEN {found(strip('line'), fixed.PROJECT_OPENING, 'i')} THEN 1
             WHEN alone IS NOT NULL THEN 0 END) AS event FROM marked)
WINDOW w AS (PARTITION BY resume_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
part("project_blocks", f"""
SELECT resume_id, block, string_agg(line, {NL} ORDER BY pos) AS project FROM block_lines
WHERE state = 1 GROUP BY resume_id, block""")
part("project_rows", """
SELECT resume_id, segment AS n, project FROM project_split JOIN project_branch b USING (resume_id) WHERE branch = 'split'
UNION ALL
SELECT resume_id, chunk, project FROM project_chunks JOIN project_branch b USING (resume_id) WHERE branch = 'chunks'
UNION ALL
SELECT resume_id, 1, projects_text FROM project_branch WHERE branch = 'whole'
UNION ALL
SELECT resume_id, block, project FROM project_blocks JOIN project_branch b USING (resume_id) WHERE branch = 'blocks'""")

# --- skills ------------------------------------------------------------------------------------------------------------

part("matched", r"""
SELECT r.batch_id, r.resume_id, v.ord, v.skill
FROM resumes r JOIN vocab v ON regexp_matches(lower(r.raw_text), '\b' || regexp_escape(v.skill) || '\b')""")
part("job_named", r"""
SELECT j.batch_id, v.ord, v.skill
FROM jobs j JOIN vocab v ON regexp_matches(lower(j.job_description), '\b' || regexp_escape(v.skill) || '\b')""")
part("job_skill_rows", """
SELECT batch_id, ord, skill FROM job_named
UNION ALL
SELECT batch_id, 1000 + min(r.ord), r.skill FROM jobs j JOIN roles r ON contains(lower(j.job_description), r.phrase)
WHERE NOT EXISTS (SELECT 1 FROM job_named n WHERE n.batch_id = j.batch_id AND n.skill = r.skill)
GROUP BY batch_id, r.skill""")
part("job_sizes", """
SELECT j.batch_id, count(DISTINCT s.skill) AS wanted FROM jobs j LEFT JOIN job_skill_rows s USING (batch_id)
GROUP BY j.batch_id""")
part("skill_stats", """
SELECT r.batch_id, r.resume_id, count(m.skill) AS skills_count,
       count(DISTINCT s.skill) AS hits, any_value(z.wanted) AS wanted,
       coalesce(string_agg(m.skill, '|' ORDER BY m.ord), '') AS matched_skills,
       coalesce(string_agg(m.skill, '|' ORDER BY m.ord) FILTER (s.skill IS NOT NULL), '') AS jd_matched_skills,
       (CASE WHEN any_value(z.wanted) > 0 THEN count(DISTINCT s.skill) / CAST(any_value(z.wanted) AS DOUBLE)
        ELSE CAST(0 AS DOUBLE) END) AS jd_overlap
FROM resumes r JOIN job_sizes z USING (batch_id) LEFT JOIN matched m ON m.resume_id = r.resume_id
LEFT JOIN (SELECT DISTINCT batch_id, skill FROM job_skill_rows) s ON s.batch_id = r.batch_id AND s.skill = m.skill
GROUP BY r.batch_id, r.resume_id""")

# --- similarity ----------------------------------------------------------------------------------------------------------

part("job_terms", f"""
SELECT batch_id, term, CAST(count(*) AS DOUBLE) AS tf FROM (
  SELECT batch_id, unnest(regexp_extract_all(lower(CASE WHEN {blank('job_description')}
         THEN '{fixed.DEFAULT_JOB}' ELSE job_description END), '[a-z0-9]+')) AS term FROM jobs)
GROUP BY batch_id, term""")
part("job_norms", "SELECT batch_id, sqrt(sum(tf * tf)) AS norm FROM job_terms GROUP BY batch_id")


def cosine_part(name: str, rows: str) -> None:
    """Cosine with the batch's job for every ``(resume_id, n)`` text of ``rows``."""
    part(name, f"""
SELECT resume_id, n, coalesce(dot / (norm * job_norm), CAST(0 AS DOUBLE)) AS cosine FROM (
  SELECT t.resume_id, t.n, sqrt(sum(t.tf * t.tf)) AS norm, sum(t.tf * j.tf) AS dot,
         any_value(k.norm) AS job_norm
  FROM (SELECT resume_id, batch_id, n, term, CAST(count(term) AS DOUBLE) AS tf FROM (
          SELECT resume_id, batch_id, n, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS term
          FROM (SELECT x.resume_id, x.n, r.batch_id, regexp_extract_all(lower(x.txt), '[a-z0-9]+') AS l
                FROM ({rows}) x JOIN resumes r USING (resume_id)))
        GROUP BY resume_id, batch_id, n, term) t
  JOIN job_norms k ON k.batch_id = t.batch_id
  LEFT JOIN job_terms j ON j.batch_id = t.batch_id AND j.term = t.term
  GROUP BY t.resume_id, t.n)""")


cosine_part("resume_cosines", "SELECT resume_id, 0 AS n, raw_text AS txt FROM resumes")
cosine_part("certificate_cosines", "SELECT resume_id, n, mention AS txt FROM certificate_rows")
cosine_part("project_cosines", "SELECT resume_id, n, project AS txt FROM project_rows")


def match_score(cosine: str) -> str:
    return (f"least(greatest(({cosine} - CAST(0.1 AS DOUBLE)) * CAST(1.5 AS DOUBLE), "
            f"CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))")


part("certificate_scores", f"""
SELECT resume_id, least(coalesce(sum(cosine) FILTER (cosine > 0.1), 0),
       CAST(1 AS DOUBLE)) AS certificate_relevance FROM certificate_cosines GROUP BY resume_id""")


def project_score(cosine: str, limit: float = 0.3) -> str:
    kept = f"FILTER ({cosine} > {limit})"
    boost = (f"least((count(*) {kept}) * CAST(0.05 AS DOUBLE), "
             f"CAST(0.15 AS DOUBLE))")
    return (f"(CASE WHEN (count(*) {kept}) > 0 THEN least(avg({cosine}) {kept} + {boost}, CAST(1 AS DOUBLE)) "
            f"ELSE CAST(0 AS DOUBLE) END)")


part("project_scores", f"""
SELECT resume_id, {project_score('cosine')} AS project_relevance,
       count(*) FILTER (cosine > 0.3) AS relevant_projects_count
FROM project_cosines GROUP BY resume_id""")

# --- scores -----------------------------------------------------------------------------------------------------------------

part("feature_rows", f"""
SELECT r.batch_id, r.resume_id, r.ordinal, r.filename, n.name, length(r.raw_text) AS text_length,
       s.skills_count, s.matched_skills, s.jd_matched_skills, s.wanted, s.jd_overlap,
       {match_score('c.cosine')} AS skills_match_score, y.has_experience, y.experience_years,
       coalesce(ce.certificate_relevance, 0) AS certificate_relevance, k.has_contact,
       coalesce(p.project_relevance, 0) AS project_relevance,
       coalesce(p.relevant_projects_count, 0) AS relevant_projects_count, e.education_quality
FROM resumes r JOIN names n USING (resume_id) JOIN skill_stats s USING (resume_id)
JOIN resume_cosines c USING (resume_id) JOIN years y USING (resume_id) JOIN contacts k USING (resume_id)
JOIN education_scores e USING (resume_id)
LEFT JOIN certificate_scores ce USING (resume_id) LEFT JOIN project_scores p USING (resume_id)""")


# The twins state weights, thresholds and sizes as numbers of their own, so that a wrong constant shows.
STATED_WEIGHTS = {"jd_skill_overlap": 0.22, "skills_match": 0.15, "experience": 0.13, "certificates": 0.10,
                  "contact_info": 0.05, "skills_count": 0.10, "project_relevance": 0.15, "education_quality": 0.10}


def weighted(terms: list[tuple[str, str]]) -> str:
    return " + ".join(f"{value} * CAST({STATED_WEIGHTS[name]} AS DOUBLE)" for name, value in terms)


_norm = f"least(experience_years / CAST(15 AS DOUBLE), CAST(1 AS DOUBLE))"
part("quality_rows", f"""
SELECT *, {weighted([
    ("jd_skill_overlap", "jd_overlap"), ("skills_match", "skills_match_score"), ("experience", "exp_norm"),
    ("certificates", "certificate_relevance"), ("contact_info", "has_contact"),
    ("skills_count", "least(skills_count / CAST(15 AS DOUBLE), CAST(1 AS DOUBLE))"),
    ("project_relevance", "project_relevance"), ("education_quality", "education_quality")])} AS quality_score
FROM (SELECT *, (CASE WHEN experience_years = 0 AND (skills_count >= 5 OR project_relevance > 0.3)
                 THEN CAST(0.1 AS DOUBLE) ELSE {_norm} END) AS exp_norm FROM feature_rows)""")
_blend = "((quality_score * CAST(0.8 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(0.2 AS DOUBLE)) * 100)"
part("blended", f"SELECT *, {python_round(_blend, 1)} AS score FROM quality_rows")
_keyword = ("((CASE WHEN wanted > 0 THEN jd_overlap ELSE skills_count / CAST(302 AS DOUBLE) END) * 100)")
part("keyword_rows", f"""
SELECT r.batch_id, r.resume_id, r.ordinal, r.filename, n.name, length(r.raw_text) AS text_length,
       s.skills_count, s.matched_skills, s.jd_matched_skills, s.jd_overlap, {python_round(_keyword, 1)} AS score,
       y.experience_years, e.education_quality
FROM resumes r JOIN names n USING (resume_id) JOIN skill_stats s USING (resume_id) JOIN years y USING (resume_id)
JOIN education_scores e USING (resume_id)""")


def outliers(rows: str) -> str:
    """``rows`` with the flag; limits from exact sums."""
    return f"""
SELECT d.*, l.sd > 0 AND d.text_length > l.mean + 2 * l.sd AS is_anomaly
FROM {rows} d JOIN (
  SELECT batch_id, s1 / CAST(n AS DOUBLE) AS mean,
         (CASE WHEN n > 1 THEN sqrt(CAST(n * s2 - s1 * s1 AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE))
          ELSE CAST(0 AS DOUBLE) END) AS sd
  FROM (SELECT batch_id, count(*) AS n, sum(CAST(text_length AS HUGEINT)) AS s1,
               sum(CAST(text_length AS HUGEINT) * text_length) AS s2 FROM {rows} GROUP BY batch_id)) l USING (batch_id)"""


part("keyword_flagged", outliers("keyword_rows"))
part("ranked", """
SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY score DESC, ordinal) AS rank FROM keyword_flagged""")
part("blended_ranked", """
SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY score DESC, ordinal) AS rank FROM blended""")
