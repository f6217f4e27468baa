"""The expected results as SQL over the given tables."""

from __future__ import annotations

_PINO_LEVEL = (
    "CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 20 WHEN 'signup' THEN 30 "
    "WHEN 'purchase' THEN 40 ELSE 50 END"
)
_NAME = (
    "CASE event_type WHEN 'view' THEN 'trace' WHEN 'click' THEN 'debug' WHEN 'signup' THEN 'info' "
    "WHEN 'purchase' THEN 'warn' ELSE 'error' END"
)
_CENTS = "CAST(round(value * 100) AS BIGINT)"
_MILLIS = "epoch_us(ts) // 1000"
_PROPS_K = "json_extract_string(props, '$.k')"
_PINO_LINE = (
    f"""'{{"level":' || {_PINO_LEVEL} || ',"time":' || {_MILLIS} || ',"msg":"' || event_type || """
    """'","pid":' || user_id || ',"id":' || event_id || ',"props":' || props || '}'"""
)
_PINO_FIELDS = f"'id=' || event_id || ';pid=' || user_id || ';props.k=' || {_PROPS_K}"
_MS_STAMP = "strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S.%g')"
_PINO_STAMP = _MS_STAMP.format(us=f"({_MILLIS}) * 1000")
_ZAP_US = "(epoch_us(ts) // 1000000) * 1000000 + 500000"
_BADGE = f"lpad(upper({_NAME}), 5, ' ')"
_TS_STAMP = _MS_STAMP.format(us="epoch_us(ts)")
_PLAIN_BADGE = (
    "CASE event_type WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'DEBUG' WHEN 'signup' THEN ' INFO' "
    "WHEN 'purchase' THEN ' WARN' ELSE 'ERROR' END"
)
_KIND = (
    "CASE event_id % 10 WHEN 0 THEN 'raw' WHEN 2 THEN 'raw' WHEN 3 THEN 'raw' ELSE 'json' END"
)
_HAS_LEVEL = "event_id % 10 NOT IN (0, 1, 2, 3)"
_MIXED = f"""(SELECT *, CASE event_id % 10
  WHEN 0 THEN 'plain ' || event_type || ' ' || event_id
  WHEN 1 THEN replace(pino, '"level":' || {_PINO_LEVEL} || ',', '')
  WHEN 2 THEN substr(pino, 1, length(pino) - 1) || ',}}'
  WHEN 3 THEN '' ELSE pino END AS line
  FROM (SELECT *, {_PINO_LINE} AS pino FROM events))"""
_LINE_END = "chr(10)"
_STAMP_US = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
_RAW_LEVEL = (
    "CASE event_type WHEN 'view' THEN 'trc' WHEN 'click' THEN 'Debug' WHEN 'signup' THEN 'info' "
    "WHEN 'purchase' THEN 'WARNING' ELSE 'err' END"
)


def _extra(key: str, value: str, width: int = 25) -> str:
    """A leftover field on a line of its own."""
    return f"""{_LINE_END} || '{key.rjust(width)}: ' || {value}"""


_SINGLE_PINO = (
    f"{_PINO_STAMP} || '  ' || {_BADGE} || ': ' || event_type || ' id=' || event_id || ' pid=' || "
    f"user_id || ' props.k=' || {_PROPS_K}"
)
_STYLE = (
    "CASE event_type WHEN 'view' THEN '36' WHEN 'click' THEN '34' WHEN 'signup' THEN '32' "
    "WHEN 'purchase' THEN '33' ELSE '95' END"
)


def _cut(text: str, limit: int) -> str:
    return (
        f"CASE WHEN length({text}) > {limit} THEN substr({text}, 1, {limit}) || '…' ELSE {text} END"
    )


def _documents(limit: int) -> str:
    whole = _cut("text", limit) if limit else "text"
    return (
        "'lang=' || lang || ';meta.chars=' || n_chars || ';meta.tongue=' || lang || "
        f"';whole=' || {whole}"
    )


ORACLES: dict[str, str] = {
    "read_log_files": f"""SELECT {_NAME} AS level, event_type AS message,
        CAST(1 AS BIGINT) AS n_missing, count(*) OVER () AS n_lines,
        row_number() OVER (ORDER BY event_id) - 1 AS position, TRUE AS numbered,
        CAST(event_id AS VARCHAR) AS id FROM events""",
    "read_unnumbered": f"""SELECT {_NAME} AS level, event_type AS message,
        CAST(event_id AS VARCHAR) AS id FROM events""",
    "stream_log_lines": f"SELECT {_SINGLE_PINO} AS rendered FROM events",
    "parse_column": """SELECT doc_id, 'json' AS kind, text AS message, source AS caller
        FROM documents""",
    "drop_invalid_utf8": "SELECT event_id FROM events WHERE event_type <> 'view'",
    "classify_lines": f"""SELECT event_id, {_KIND} AS kind,
        CASE WHEN {_KIND} = 'json' THEN line END AS raw_json FROM {_MIXED}""",
    "strict_json": """SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'json' ELSE 'raw' END AS kind
        FROM events""",
    "classify_pages": """SELECT page_id, CASE WHEN json_valid(substr(html, strpos(html, '{')))
        THEN 'embedded' ELSE 'raw' END AS kind FROM pages""",
    "embedded_json": """SELECT event_id, 'embedded' AS kind, 'app-' || user_id || ' | ' AS prefix,
        'error' AS level, event_type AS message, epoch_us(ts) AS ts_us FROM events""",
    "double_escape_repair": f"""SELECT event_id, 'json' AS kind, event_type AS message,
        'a' || {_LINE_END} || '"b"' AS error,
        '{{"time":"' || {_STAMP_US} || '","level":"' || {_RAW_LEVEL} || '","msg":"' || event_type ||
        '","error":"a\\n\\"b\\"","cents":' || {_CENTS} || '}}' AS raw_json FROM events""",
    "sanitize_newlines": f"""SELECT conv_id, turn, '{{"level":"info","conv":' || conv_id ||
        ',"turn":' || turn || ',"msg":"' || replace(text, {_LINE_END}, '\\n') || '"}}' AS sanitized
        FROM conversations""",
    "multiline_reassembly": """SELECT text AS message, CAST(conv_id AS VARCHAR) AS conv,
        CAST(turn AS VARCHAR) AS turn FROM conversations""",
    "multiline_one_source": """SELECT text AS message, CAST(conv_id AS VARCHAR) AS conv,
        CAST(turn AS VARCHAR) AS turn FROM conversations""",
    "stream_multiline": """SELECT text AS message, CAST(conv_id AS VARCHAR) AS conv,
        CAST(turn AS VARCHAR) AS turn FROM conversations""",
    "parse_diagnostics": f"""SELECT event_id, CASE event_id % 10
          WHEN 4 THEN 'invalid JSON: unexpected end' WHEN 5 THEN 'invalid JSON: trailing characters'
          WHEN 2 THEN 'invalid JSON: unexpected character'
          WHEN 6 THEN 'invalid JSON: unexpected character'
          WHEN 7 THEN 'invalid JSON: unexpected character' END AS problem,
        CAST(CASE WHEN event_id % 10 = 6 THEN 2 WHEN event_id % 10 IN (2, 4, 5, 7) THEN 1 END AS BIGINT)
          AS at_line,
        CASE event_id % 10 WHEN 2 THEN length(line) WHEN 4 THEN length(line) - 1
          WHEN 5 THEN length(line) + 2 WHEN 6 THEN 1 WHEN 7 THEN strpos(line, '"msg":"') + 8 END
          AS at_column
        FROM {_MIXED}""",
    "resolve_fields": """SELECT event_id, event_type AS message, 'svc' AS logger,
        'a.go:' || user_id AS caller, CAST(NULL AS VARCHAR) AS error,
        CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.5' AS ts_text
        FROM events""",
    "custom_keys": f"""SELECT event_id, 'a.go:' || user_id AS message,
        CAST({_CENTS} AS VARCHAR) AS logger, CAST(NULL AS VARCHAR) AS caller,
        'logger=svc;msg=' || event_type AS fields FROM events""",
    "matched_alias": "SELECT event_id, 'event' AS matched_alias FROM events",
    "ts_from_string": """SELECT event_id, epoch_us(ts) AS ts_us, CAST(0 AS BIGINT) AS ts_nanos
        FROM events""",
    "ts_from_epoch": f"""SELECT event_id, ({_MILLIS}) * 1000 AS ts_us, CAST(0 AS BIGINT) AS ts_nanos
        FROM events""",
    "ts_from_nanos": """SELECT event_id, epoch_us(ts) AS ts_us, CAST(0 AS BIGINT) AS ts_nanos
        FROM events""",
    "ts_from_float": f"""SELECT event_id, {_ZAP_US} AS ts_us, CAST(0 AS BIGINT) AS ts_nanos
        FROM events""",
    "ts_rare_shapes": """SELECT event_id, CASE event_id % 4
          WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 1 THEN epoch_us(ts) // 60000000 * 60000000
          WHEN 2 THEN epoch_us(ts) ELSE epoch_us(ts) // 1000 * 1000 END AS ts_us,
        CAST(0 AS BIGINT) AS ts_nanos FROM events""",
    "epoch_shapes": f"""SELECT event_id, CASE event_id % 4
        WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 1 THEN -event_id * 1000000
        WHEN 2 THEN NULL ELSE ({_MILLIS}) * 1000 END AS ts_us,
        CASE WHEN event_id % 4 <> 2 THEN CAST(0 AS BIGINT) END AS ts_nanos FROM events""",
    "level_shapes": """SELECT event_id, CASE num WHEN 10 THEN 'trace' WHEN 20 THEN 'debug'
        WHEN 30 THEN 'info' WHEN 40 THEN 'warn' WHEN 50 THEN 'error' WHEN 60 THEN 'fatal' END AS level,
        CAST(num AS BIGINT) AS level_num FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL
        ELSE least(60, greatest(10, (event_id % 70 + 5) // 10 * 10)) END AS num FROM events)""",
    "level_from_name": f"""SELECT event_id, {_NAME} AS level,
        CAST({_PINO_LEVEL} AS BIGINT) AS level_num FROM events""",
    "level_from_number": f"""SELECT event_id, {_NAME} AS level,
        CAST({_PINO_LEVEL} AS BIGINT) AS level_num FROM events""",
    "custom_levels": """SELECT event_id, 'debug' AS level, CAST(20 AS BIGINT) AS level_num
        FROM events""",
    "role_text": """SELECT event_id, json(props) AS message, CAST(user_id AS VARCHAR) AS logger
        FROM events""",
    "flatten_extra": f"SELECT event_id, {_PINO_FIELDS} AS fields FROM events",
    "extra_text": f"SELECT doc_id, {_documents(0)} AS fields FROM documents",
    "nested_numbers": """SELECT event_id,
        '{"a":10000000000.0,"b":1.0,"c":-0.0,"id":' || event_id || ',"s":"1e10"}' AS message,
        'n.x={"a":[10000000000.0,' || event_id || ',1.5],"big":1e300,"y":' || user_id || '.0}'
        AS fields FROM events""",
    "grep_line_end": """SELECT doc_id FROM documents
        WHERE lang = 'en' AND right(text, 1) = '.'""",
    "parse_other_column": """SELECT doc_id, 'unrelated' AS line, text AS rendered FROM documents
        WHERE regexp_matches(text, '[a-z]')""",
    "filter_min_level": f"""SELECT event_id, {_NAME} AS level, event_type AS message FROM events
        WHERE {_PINO_LEVEL} >= 40""",
    "filter_min_level_mixed": f"""SELECT event_id, {_KIND} AS kind,
        CASE WHEN {_HAS_LEVEL} THEN {_NAME} END AS level FROM events
        WHERE NOT {_HAS_LEVEL} OR {_PINO_LEVEL} >= 50""",
    "grep_fields": r"""SELECT doc_id, source AS caller FROM documents
        WHERE regexp_matches(source, '\bsrc[0-4]\b') OR regexp_matches(text, '\bsrc[0-4]\b|^fr$')
        OR lang = 'fr'""",
    "grep_raw": """SELECT doc_id, 'raw' AS kind FROM documents
        WHERE regexp_matches(text, '(ing|tion)s? [a-m]')""",
    "json_records_only": f"""SELECT event_id, 'json' AS kind, event_type AS message FROM events
        WHERE {_KIND} = 'json'""",
    "drop_empty": f"SELECT event_id, {_KIND} AS kind FROM events WHERE event_id % 10 <> 3",
    "filter_combined": f"""SELECT event_id, {_KIND} AS kind,
        CASE WHEN {_HAS_LEVEL} THEN {_NAME} END AS level FROM {_MIXED}
        WHERE CASE WHEN {_KIND} = 'raw' THEN regexp_matches(line, '^(error|7)$|plain e')
        ELSE (NOT {_HAS_LEVEL} OR {_PINO_LEVEL} >= 30)
          AND (event_type = 'error' OR 7 IN (user_id, event_id, CAST({_PROPS_K} AS BIGINT))) END""",
    "include_fields": f"SELECT event_id, 'props.k=' || {_PROPS_K} AS fields FROM events",
    "exclude_fields": """SELECT event_id, 'id=' || event_id || ';pid=' || user_id AS fields
        FROM events""",
    "no_extra": "SELECT event_id, '' AS fields FROM events",
    "truncate_values": f"SELECT doc_id, {_documents(40)} AS fields FROM documents",
    "sorted_extras": f"SELECT doc_id, {_documents(0)} AS fields FROM documents",
    "select_fields": f"""SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS pid,
        {_PROPS_K} AS k, CAST(NULL AS VARCHAR) AS absent, {_NAME} AS level FROM events""",
    "render_text": f"""SELECT event_id, {_PINO_STAMP} || '  ' || {_BADGE} || ': ' || event_type ||
        {_extra('id', 'event_id')} || {_extra('pid', 'user_id')} || {_extra('props.k', _PROPS_K)}
        AS rendered FROM events""",
    "render_embedded": f"""SELECT event_id, {_MS_STAMP.format(us='epoch_us(ts)')} ||
        '  ERROR: app-' || user_id || ' |  ' || event_type AS rendered FROM events""",
    "render_mixed": f"""SELECT event_id, CASE event_id % 10
        WHEN 0 THEN line WHEN 2 THEN line || {_LINE_END} || '  parse error: [1:' || length(line) ||
          '] invalid JSON: unexpected character'
        WHEN 1 THEN {_SINGLE_PINO.replace(_BADGE, "'     '")}
        ELSE {_SINGLE_PINO} END AS rendered FROM {_MIXED} WHERE event_id % 10 <> 3""",
    "level_badge": f"""SELECT event_id, CASE WHEN {_HAS_LEVEL} THEN {_BADGE} ELSE '     ' END AS badge
        FROM events""",
    "render_single_line": f"""SELECT event_id, {_MS_STAMP.format(us=_ZAP_US)} || '       : svc ' ||
        event_type || ' (a.go:' || user_id || ') cents=' || {_CENTS} AS rendered FROM events""",
    "render_slog": f"""SELECT event_id, {_TS_STAMP} || '  ' || {_PLAIN_BADGE} || ': checker-' ||
        user_id || ' ' || event_type || ' (monitor) cents=' || {_CENTS} || ' host=web-' ||
        event_id % 10 || ' limit=1500' AS rendered FROM events""",
    "render_bunyan": f"""SELECT event_id, {_TS_STAMP} || '  ' || {_BADGE} || ': shop ' || event_type ||
        ' ({{"file":"db/pool.x","line":' || event_id % 500 || '}}) cents=' || {_CENTS} ||
        ' hostname=host-' || event_id % 10 || ' pid=' || user_id || ' v=0 waiting=15' AS rendered
        FROM events""",
    "render_structlog": f"""SELECT event_id, {_TS_STAMP} || '  ' || {_PLAIN_BADGE} || ': shop.orders ' ||
        event_type || ' amount=' || event_id % 100 || '.25 currency=EUR customer_id=c-' || user_id ||
        ' method=card region=eu-1 transaction_id=t-' || event_id AS rendered FROM events""",
    "render_error_block": f"""SELECT event_id, {_MS_STAMP.format(us='epoch_us(ts)')} || '  ' ||
        {_BADGE} || ': ' || event_type || {_extra('cents', _CENTS, 8)} || {_LINE_END} ||
        '   error: first' || {_LINE_END} || '          second' || {_LINE_END} || '          third'
        AS rendered FROM events""",
    "format_timestamp": """SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M:%S.%f % %j') AS shown
        FROM events""".replace("% %j", "%% %j"),
    "timezone_convert": """SELECT event_id, strftime(timezone('America/New_York',
        timezone('UTC', ts)), '%Y-%m-%d %H:%M') AS shown FROM events""",
    "format_timestamp_zone": """SELECT event_id, strftime(here, '%Y-%m-%dT%H:%M:%S') || CASE
        WHEN date_diff('hour', here, there) = 5 THEN '-05:00 EST -0500 ' ELSE '-04:00 EDT -0400 ' END ||
        lpad(CAST(hour(here) AS VARCHAR), 2, ' ') || '|' ||
        lpad(CAST((hour(here) + 11) % 12 + 1 AS VARCHAR), 2, ' ') || '|' ||
        CASE WHEN hour(here) < 12 THEN 'am' ELSE 'pm' END || ' ' ||
        lpad(CAST(day(here) AS VARCHAR), 2, ' ') AS shown
        FROM (SELECT event_id, there, timezone('America/New_York', timezone('UTC', there)) AS here
          FROM (SELECT event_id, ts + to_days(CAST(event_id % 365 AS INTEGER)) AS there FROM events))""",
    "grep_escaped_group": "SELECT doc_id FROM documents WHERE doc_id % 2 = 0",
    "timezone_local": """SELECT event_id, strftime(here, '%Y-%m-%d %H:%M') ||
        CASE WHEN date_diff('hour', here, there) = 5 THEN ' -0500' ELSE ' -0400' END AS shown
        FROM (SELECT event_id, there, timezone('America/New_York', timezone('UTC', there)) AS here
          FROM (SELECT event_id, ts + to_days(CAST(event_id % 365 AS INTEGER)) AS there FROM events))""",
    "long_records": f"""SELECT event_id, {_NAME} AS level, event_type AS message, {_PINO_FIELDS} ||
        ';x=' || CASE WHEN event_id % 2000 = 0 THEN '17000000' ELSE 'aaaaaaaaaa' END AS fields,
        'BIGINT' AS pid_type FROM events""",
    "format_timestamp_fraction": """
        WITH t AS (SELECT event_id, event_id % 4 AS k,
            make_timestamp((epoch_us(ts) + (event_id % 3000) * 86400000000) // 1000000 * 1000000) AS s
          FROM events),
        f AS (SELECT event_id, s, CASE k WHEN 0 THEN '000000000' WHEN 1 THEN '007000000'
            WHEN 2 THEN '120034000' ELSE '120034005' END AS f,
            CASE k WHEN 0 THEN '' WHEN 1 THEN '.007' WHEN 2 THEN '.120034' ELSE '.120034005' END AS p
          FROM t)
        SELECT event_id, strftime(s, '%S') || p || '|' || f || strftime(s, '|%-d.') ||
          lpad(strftime(s, '%-m'), 2, ' ') || strftime(s, '.%d|%a %b ') ||
          lpad(strftime(s, '%-d'), 2, ' ') || strftime(s, ' %H:%M:%S %Y|%m/%d/%y|%H:%M:%S|%u%w|%V %G|') ||
          strftime(s, '%U-%W|') || (year(s) // 100) || lpad(CAST(isoyear(s) % 100 AS VARCHAR), 2, '0') ||
          strftime(s, '|%Y-%m-%dT%H:%M:%S') || p || '+00:00' AS shown FROM f""",
    "follow_files": """SELECT unnest(string_split(' INFO: ' || text || ' conv=' || conv_id || ' turn=' ||
        turn, chr(10))) AS rendered FROM conversations""",
    "files_to_text": """SELECT row_number() OVER (ORDER BY conv_id, turn, i) - 1 AS position, rendered
        FROM (SELECT conv_id, turn, unnest(lines) AS rendered, generate_subscripts(lines, 1) AS i
          FROM (SELECT conv_id, turn, string_split(' INFO: ' || text || ' conv=' || conv_id ||
            ' turn=' || turn, chr(10)) AS lines FROM conversations))""",
    "render_ansi": f"""SELECT event_id, chr(27) || '[1m' || {_MS_STAMP.format(us='epoch_us(ts)')} ||
        chr(27) || '[0m  ' || chr(27) || '[' || {_STYLE} || ';1m' || {_BADGE} || chr(27) ||
        '[0m: ' || event_type || ' ' || chr(27) || '[38;2;150;150;150;1mcents' || chr(27) ||
        '[0m=' || {_CENTS} AS rendered FROM events""",
    "write_text": f"""SELECT row_number() OVER (ORDER BY event_id, gap) - 1 AS position, rendered
        FROM (SELECT event_id, 0 AS gap, {_SINGLE_PINO} AS rendered FROM events
          UNION ALL SELECT event_id, 1, '' FROM events)""",
    "write_text_by_columns": f"""SELECT row_number() OVER (ORDER BY event_id) - 1 AS position,
        {_SINGLE_PINO} AS rendered FROM events""",
    "json_passthrough": f"""SELECT line AS value FROM {_MIXED}
        WHERE {_KIND} = 'json' AND (event_id % 10 = 1 OR {_PINO_LEVEL} >= 40)""",
    "log_table": f"""SELECT event_id, {_NAME} AS level, event_type AS message,
        ({_MILLIS}) * 1000 AS ts_us, {_PINO_FIELDS} AS fields, CAST(1 AS BIGINT) AS n_files FROM events
        WHERE {_PINO_LEVEL} >= 40""",
}
