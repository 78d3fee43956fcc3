"""The derived streams and their shared stages in SQL, for checking results with another engine."""

from __future__ import annotations

import re

from ..functions.geometry import MEASURED
from .views import EXPECTED_MARKERS, MASK_COLS, MASK_ROWS

PPD = repr(MEASURED.px_per_degree)

_FIELDS = "pupil_l_x pupil_l_y pupil_l_mm pupil_r_x pupil_r_y pupil_r_mm pos_l_x pos_l_y pos_r_x pos_r_y".split()
_LAST_FLAG = "lag(CASE WHEN flag THEN time END IGNORE NULLS) OVER (PARTITION BY subject, block, trial ORDER BY time)"
_NEXT_FLAG = "lead(CASE WHEN flag THEN time END IGNORE NULLS) OVER (PARTITION BY subject, block, trial ORDER BY time)"
_TRIAL_ORDER = "OVER (PARTITION BY subject, block, trial ORDER BY time)"

VIEWS: dict[str, str] = {
    "ev": """
        SELECT concat(CASE WHEN (user_id // 2) % 2 = 0 THEN 'a' ELSE 'b' END, user_id) AS subject,
               CASE WHEN epoch_us(ts) < 1705363200000000 THEN 1 ELSE 2 END AS block,
               epoch_us(ts) AS line, event_id, event_type, value
        FROM events""",
    "marks": """
        SELECT subject, block,
               CASE WHEN event_type = 'purchase' THEN 'Response' ELSE 'Picture' END AS event,
               CASE event_type
                 WHEN 'view' THEN concat('distractors/',
                   CASE WHEN (event_id // 4) % 2 = 0 THEN 'category1/' ELSE 'category2/' END,
                   'F', event_id % 40, '.jpg ',
                   CASE WHEN subject LIKE 'b%' THEN CAST(event_id % 4 + 1 AS VARCHAR)
                        WHEN event_id % 2 = 1 THEN 'NA'
                        WHEN (event_id // 2) % 2 = 0 THEN ':' ELSE '..' END,
                   ' | ',
                   CASE WHEN (event_id // 4) % 2 = 0 THEN 'category2/' ELSE 'category1/' END,
                   'M', event_id % 37, '.jpg ',
                   CASE WHEN subject LIKE 'b%' THEN CAST(event_id % 4 + 6 AS VARCHAR)
                        WHEN event_id % 2 = 0 THEN 'NA'
                        WHEN (event_id // 2) % 2 = 0 THEN ':' ELSE '..' END)
                 WHEN 'click' THEN 'targets'
                 WHEN 'purchase' THEN CASE WHEN event_id % 11 = 0 THEN '1'
                   WHEN subject LIKE 'a%' THEN CAST(event_id % 3 + 1 AS VARCHAR)
                   ELSE CAST(event_id % 8 + 4 AS VARCHAR) END
                 ELSE 'pause' END AS code,
               line // 100 AS time, line
        FROM ev""",
    "sequences": """
        SELECT subject, block, 11 + event_id % 2 + ((event_id // 2) % 2) * 10 AS condition,
               CASE WHEN event_id % 2 = 0 THEN 100 ELSE 500 END AS soa, event_id % 500 + 1000 AS iti,
               concat('stim/', CASE WHEN event_id % 4 < 2 THEN 'AN' ELSE 'NE' END, event_id % 40, '.jpg')
                 AS distractor_left,
               concat('stim/', CASE WHEN event_id % 4 >= 2 OR event_id % 10 = 0 THEN 'AN' ELSE 'NE' END,
                      event_id % 37, '.jpg') AS distractor_right,
               CAST(event_id % 4 + 1 AS VARCHAR) AS target_left,
               CAST(event_id % 4 + 6 AS VARCHAR) AS target_right,
               row_number() OVER (PARTITION BY subject ORDER BY line) AS trial
        FROM ev""",
    "relevant": """
        SELECT *, CASE WHEN subject LIKE 'a%' THEN 'Dot Probe' ELSE 'Dual Probe' END AS paradigm
        FROM marks
        WHERE (event = 'Response' AND code <> '1') OR code = 'targets' OR code LIKE '%distractors%'""",
    "numbered": """
        SELECT *, CASE WHEN code LIKE '%distractors%' THEN
                 count(*) FILTER (WHERE code LIKE '%distractors%')
                   OVER (PARTITION BY subject ORDER BY line ROWS UNBOUNDED PRECEDING) END AS trial
        FROM relevant""",
    "filled": """
        SELECT * EXCLUDE (trial, t), t AS trial FROM (
          SELECT *, last_value(trial IGNORE NULLS)
                      OVER (PARTITION BY subject, block ORDER BY line ROWS UNBOUNDED PRECEDING) AS t
          FROM numbered) WHERE t IS NOT NULL""",
    "trial_events": """
        SELECT * EXCLUDE (prior) FROM (
          SELECT *, lag(event) OVER (PARTITION BY subject, block ORDER BY line) AS prior FROM filled)
        WHERE NOT (event = 'Response' AND prior IS NOT DISTINCT FROM 'Response')""",
    "wide": """
        SELECT subject, block, paradigm, trial,
          arg_min(code, line) FILTER (WHERE code LIKE '%distractors%') AS code,
          arg_min(code, line) FILTER (WHERE event = 'Response') AS response,
          arg_min(time, line) FILTER (WHERE code LIKE '%distractors%') AS time_distractors,
          arg_min(time, line) FILTER (WHERE code = 'targets') AS time_target,
          arg_min(time, line) FILTER (WHERE event = 'Response') AS time_response
        FROM trial_events GROUP BY ALL""",
    "trials": """
        SELECT subject, block, paradigm, trial, response, time_distractors, time_target, time_response,
          CASE WHEN code LIKE 'distractors/category1%' THEN 'left'
               WHEN code LIKE '%| category1%' THEN 'right' END AS angry,
          regexp_extract(code, '(F[0-9]+)\\.jpg', 1) AS distractor_left,
          regexp_extract(code, '(M[0-9]+)\\.jpg', 1) AS distractor_right,
          nullif(split_part(code, ' ', 2), 'NA') AS target_left,
          nullif(split_part(code, ' ', 5), 'NA') AS target_right
        FROM wide""",
    "mapped": """
        SELECT * EXCLUDE (response, k), CASE WHEN k >= 5 THEN k + 1 ELSE k END AS response FROM (
          SELECT *, TRY_CAST(response AS INTEGER) - CASE WHEN paradigm = 'Dot Probe' THEN 1 ELSE 3 END AS k
          FROM trials)""",
    "dot": """
        SELECT *, CASE WHEN angry = target_dotprobe THEN 'angry' WHEN angry <> target_dotprobe THEN 'neutral' END
                    AS congruency_dotprobe,
          CASE WHEN paradigm = 'Dual Probe' THEN NULL
               WHEN response IS NULL THEN NULL
               ELSE target_kind_dotprobe =
                 CASE WHEN (response = 1) = (key_assign = 1) THEN ':' ELSE '..' END END AS response_dotprobe
        FROM (SELECT *,
            CASE WHEN target_right IS NULL THEN 'left' WHEN target_left IS NULL THEN 'right' END AS target_dotprobe,
            CASE WHEN target_right IS NULL THEN target_left WHEN target_left IS NULL THEN target_right END
              AS target_kind_dotprobe,
            CASE WHEN paradigm = 'Dot Probe'
                 THEN 2 - CAST(regexp_replace(subject, '\\D', '', 'g') AS INTEGER) % 2 END AS key_assign
          FROM mapped)""",
    "dual": """
        SELECT *, CASE WHEN response_dual IS NULL THEN NULL WHEN response_dual = angry THEN 'angry'
                       ELSE 'neutral' END AS congruency_dual
        FROM (SELECT *, CASE WHEN paradigm = 'Dot Probe' OR response IS NULL THEN NULL
                WHEN response = TRY_CAST(target_left AS INTEGER) THEN 'left'
                WHEN response = TRY_CAST(target_right AS INTEGER) THEN 'right'
                ELSE 'incorrect' END AS response_dual FROM dot)""",
    "timed": """
        SELECT *, (time_response - time_target) / 10 AS rt, (time_target - time_distractors) / 10 AS exposure,
          CASE WHEN (time_target - time_distractors) / 10 < 500 THEN 100
               WHEN (time_target - time_distractors) / 10 >= 500 THEN 500 END AS soa_guess,
          CASE WHEN paradigm = 'Dot Probe' THEN congruency_dotprobe ELSE congruency_dual END AS congruency
        FROM dual""",
    "scored": """
        SELECT t.*, s.soa, s.iti FROM timed t LEFT JOIN sequences s USING (subject, block, trial)""",
    "markers": """
        SELECT subject, CASE WHEN subject LIKE 'a%' THEN 'Dot Probe' ELSE 'Dual Probe' END AS paradigm,
               event_id % 255 + 1 AS value, line // 2000 AS sample, 1 AS size, 0 AS channel, line FROM ev""",
    "repaired": f"""
        SELECT subject, paradigm, v AS value, sample, size, channel, line, inverted,
          row_number() OVER (PARTITION BY subject ORDER BY line) + 1 AS marker_num
        FROM (SELECT *, CASE WHEN inverted THEN 255 - value ELSE value END AS v
              FROM (SELECT *, count(*) OVER (PARTITION BY subject) > {EXPECTED_MARKERS} AS inverted FROM markers))
        WHERE v <> 0""",
    "stages": """
        SELECT r.*, CASE WHEN marker_num % 2 = 0 THEN s.soa END AS soa, marker_num // 2 AS trial
        FROM repaired r LEFT JOIN sequences s ON s.subject = r.subject AND s.trial = r.marker_num // 2""",
    "recoded": """
        SELECT * EXCLUDE (value, plain, short), CASE
            WHEN paradigm = 'Dual Probe' AND marker_num % 2 = 0
              THEN (CASE WHEN plain < 100 THEN 1 WHEN plain > 100 THEN 2 ELSE plain END)
                   + (CASE WHEN short THEN 5 ELSE 0 END)
            ELSE value END AS value
        FROM (SELECT *, value - (CASE WHEN short THEN 5 ELSE 0 END) AS plain
              FROM (SELECT *, coalesce(paradigm = 'Dual Probe' AND soa = 100, false) AS short FROM stages))""",
    "pairs": """
        SELECT subject, (rn + 1) // 2 AS trial,
          max(value) FILTER (WHERE rn % 2 = 1) AS value_stim, max(value) FILTER (WHERE rn % 2 = 0) AS value_response,
          max(sample) FILTER (WHERE rn % 2 = 1) AS sample_stim,
          max(sample) FILTER (WHERE rn % 2 = 0) AS sample_response
        FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY line) AS rn FROM markers)
        GROUP BY ALL""",
    "latencies": """
        SELECT *, (sample_response - sample_stim) / 500 * 1000 AS stim_to_resp,
          (sample_response - sample_stim) / 500 * 1000 - soa AS rt,
          (lead(sample_stim) OVER w - sample_response) / 500 * 1000 AS resp_to_next_stim,
          (lead(sample_stim) OVER w - sample_stim) / 500 * 1000 AS stim_to_next_stim,
          (lead(sample_response) OVER w - sample_stim) / 500 * 1000 AS stim_to_next_resp
        FROM (SELECT p.*, s.block, s.soa, s.iti FROM pairs p LEFT JOIN sequences s USING (subject, trial))
        WINDOW w AS (PARTITION BY subject, block ORDER BY trial)""",
    "window_messages": """
        SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY line) AS trial, line AS time
        FROM ev WHERE event_type = 'signup'""",
    "window_samples": """
        SELECT subject, line AS time, event_id, value FROM ev WHERE event_type <> 'signup'""",
    "windowed": """
        SELECT s.subject, m.trial, s.event_id, s.time, m.time AS message_time
        FROM window_samples s JOIN window_messages m
          ON s.subject = m.subject AND s.time BETWEEN m.time - 86400000000 AND m.time + 43200000000""",
    "responses": """
        SELECT l_suppkey AS subject,
          CASE WHEN l_suppkey % 2 = 0 THEN 'Dot Probe' ELSE 'Dual Probe' END AS paradigm,
          CASE WHEN l_linestatus = 'F' THEN 100 ELSE 500 END AS soa,
          CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linenumber % 2 = 0) THEN 'angry' ELSE 'neutral' END
            AS congruency,
          l_extendedprice / 100 AS rt,
          l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_extendedprice AS o4
        FROM lineitem""",
    "cells": """
        SELECT subject, paradigm, soa, congruency, avg(rt) AS rt FROM responses GROUP BY ALL""",
    "bias": """
        SELECT subject, paradigm, soa, avg(rt) FILTER (WHERE congruency = 'angry') AS angry,
          avg(rt) FILTER (WHERE congruency = 'neutral') AS neutral,
          avg(rt) FILTER (WHERE congruency = 'angry') - avg(rt) FILTER (WHERE congruency = 'neutral') AS bias
        FROM cells GROUP BY ALL""",
    "halves": """
        SELECT subject, paradigm, soa, congruency,
          avg(rt) FILTER (WHERE n % 2 = 1) AS odd, avg(rt) FILTER (WHERE n % 2 = 0) AS even
        FROM (SELECT *, row_number() OVER (PARTITION BY subject, paradigm, soa, congruency
                                           ORDER BY o1, o2, o3, o4) AS n FROM responses) GROUP BY ALL""",
    "vectors": """
        SELECT vec_id, concat(CASE WHEN (vec_id // 40) % 2 = 0 THEN 'a' ELSE 'b' END, vec_id // 40) AS subject,
          CASE WHEN vec_id % 40 < 20 THEN 1 ELSE 2 END AS block, vec_id % 40 + 1 AS trial,
          CAST(embedding AS DOUBLE[]) AS e FROM embeddings""",
    "gaze_messages": """
        SELECT subject, block, trial, CAST(250 + (vec_id % 11) * 10 AS DOUBLE) AS onset,
          CASE WHEN vec_id % 2 = 0 THEN 100 ELSE 500 END AS soa,
          CASE WHEN (vec_id // 2) % 2 = 0 THEN 'left' ELSE 'right' END AS angry,
          CASE WHEN subject LIKE 'a%' THEN 'Dot Probe' ELSE 'Dual Probe' END AS paradigm FROM vectors""",
    "eyes": """
        SELECT vec_id, subject, block, trial, i, e[i + 1] AS p, e[64 - i] AS q,
          (vec_id + i) % 29 = 7 AS lost, (vec_id * 7 + i) % 17 = 0 AS one_eye,
          960.0 + CASE WHEN e[(i // 16) * 16 + 1] >= 0 THEN 150.0 ELSE -150.0 END + e[i + 1] * 30.0 AS x,
          600.0 + e[64 - i] * 30.0 AS y
        FROM vectors, range(64) AS r(i)""",
    "raw_samples": """
        SELECT subject, block, trial, CAST(i * 10 AS DOUBLE) AS time,
          CASE WHEN lost THEN 0 ELSE p * 10.0 + 500.0 END AS pupil_l_x,
          CASE WHEN lost THEN 0 ELSE q * 10.0 + 400.0 END AS pupil_l_y,
          CAST(CASE WHEN lost OR abs(p) < 0.001 THEN 0 ELSE 3 END AS DOUBLE) AS pupil_l_mm,
          CASE WHEN lost THEN 0 ELSE p * 10.0 + 700.0 END AS pupil_r_x,
          CASE WHEN lost THEN 0 ELSE q * 10.0 + 400.0 END AS pupil_r_y,
          CAST(CASE WHEN lost OR abs(p) < 0.001 THEN 0 ELSE 3 END AS DOUBLE) AS pupil_r_mm,
          CASE WHEN lost THEN 0 ELSE x - 2.0 END AS pos_l_x, CASE WHEN lost THEN 0 ELSE y - 2.0 END AS pos_l_y,
          CASE WHEN lost OR one_eye THEN 0 ELSE x + 2.0 END AS pos_r_x,
          CASE WHEN lost OR one_eye THEN 0 ELSE y + 2.0 END AS pos_r_y
        FROM eyes""",
    "interpolated": f"""
        SELECT subject, block, trial, time,
          {", ".join(f"CASE WHEN gap THEN (before.{f} + after.{f}) / 2 ELSE {f} END AS {f}" for f in _FIELDS)}
        FROM (SELECT *, coalesce({" + ".join(_FIELDS)} = 0 AND before IS NOT NULL AND after IS NOT NULL
                AND pupil_l_x <> before.pupil_l_x AND pupil_l_x <> after.pupil_l_x, false) AS gap
              FROM (SELECT *, lag({{{", ".join(f"'{f}': {f}" for f in _FIELDS)}}}) {_TRIAL_ORDER} AS before,
                      lead({{{", ".join(f"'{f}': {f}" for f in _FIELDS)}}}) {_TRIAL_ORDER} AS after
                    FROM raw_samples))""",
    "merged": """
        SELECT *, CASE WHEN pos_r_x = 0 THEN pos_l_x WHEN pos_l_x = 0 THEN pos_r_x
                       ELSE (pos_l_x + pos_r_x) / 2 END AS x,
          CASE WHEN pos_r_y = 0 THEN pos_l_y WHEN pos_l_y = 0 THEN pos_r_y
               ELSE (pos_l_y + pos_r_y) / 2 END AS y
        FROM interpolated""",
    "samples": f"""
        SELECT subject, block, trial, time, blink, CASE WHEN NOT blink THEN x END AS x,
               CASE WHEN NOT blink THEN y END AS y
        FROM (SELECT *, shut OR coalesce(lag(shut, 2) {_TRIAL_ORDER}, false)
                       OR coalesce(lead(shut, 2) {_TRIAL_ORDER}, false) AS blink
              FROM (SELECT *, pupil_l_mm = 0 OR pupil_r_mm = 0 AS shut FROM merged))""",
    "speeds": f"""
        SELECT *, CASE WHEN pt IS NULL THEN 0 ELSE
            sqrt(((x - px) / {PPD}) * ((x - px) / {PPD}) + ((y - py) / {PPD}) * ((y - py) / {PPD}))
            / ((time - pt) / 1000.0) END AS speed
        FROM (SELECT *, lag(time) {_TRIAL_ORDER} AS pt, lag(x) {_TRIAL_ORDER} AS px, lag(y) {_TRIAL_ORDER} AS py,
                lead(x) {_TRIAL_ORDER} AS nx, lead(y) {_TRIAL_ORDER} AS ny, lead(time) {_TRIAL_ORDER} AS nt
              FROM (SELECT subject, block, trial, time, blink, coalesce(x, 0) AS x, coalesce(y, 0) AS y
                    FROM samples))""",
    "flags": f"""
        SELECT *, speed > 30 OR coalesce((speed - lag(speed) {_TRIAL_ORDER}) / ((time - pt) / 1000.0), 0) > 8000
                  OR blink AS flag FROM speeds""",
    "islands": f"""
        SELECT *, flag OR coalesce(next_t - last_t < 50, false) AS saccade,
          count(*) FILTER (WHERE flag AND (last_t IS NULL OR time - last_t >= 50))
            OVER (PARTITION BY subject, block, trial ORDER BY time ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, {_LAST_FLAG} AS last_t, {_NEXT_FLAG} AS next_t FROM flags)""",
    "runs": """
        SELECT subject, block, trial, run, saccade, min(time) AS start, max(time) AS "end",
          round(avg(x), 9) AS x, round(avg(y), 9) AS y, arg_min({'x': px, 'y': py}, time) AS origin,
          arg_max({'x': nx, 'y': ny}, time) AS target, bool_or(blink) AS blink,
          bool_or(pt IS NULL OR nt IS NULL) AS at_edge, count(*) AS samples
        FROM islands GROUP BY ALL""",
    "fixations": """
        SELECT subject, block, trial, start, "end", round_even(x, 2) AS x, round_even(y, 2) AS y,
               onset, soa, angry, paradigm
        FROM (SELECT subject, block, trial, start, "end", x, y FROM runs WHERE NOT saccade)
        JOIN gaze_messages USING (subject, block, trial)""",
    "exposed": """
        SELECT * EXCLUDE (s, e), s AS start, e AS "end", e - s AS dur FROM (
          SELECT * EXCLUDE (start, "end"), greatest(start - onset, 0) AS s, least("end" - onset, soa) AS e
          FROM fixations) WHERE e - s > 0""",
    "valid": """
        SELECT subject, block, trial, soa, sum(dur) / soa AS valid, count(*) AS n
        FROM exposed GROUP BY subject, block, trial, soa""",
    "baselines": """
        SELECT subject, block, trial, round(sum(x * w) / nullif(sum(w), 0), 9) AS x,
          round(sum(y * w) / nullif(sum(w), 0), 9) AS y
        FROM (SELECT *, CASE WHEN "end" - onset > -300 AND start - onset < 0
                THEN least("end" - onset, 0) - greatest(start - onset, -300) END AS w FROM fixations)
        GROUP BY ALL""",
    "flagged_baselines": """
        SELECT *, x IS NOT NULL AND trial % 7 <> 0 AS ok FROM baselines""",
    "sided": """
        SELECT *, CASE WHEN roi_side = angry THEN 'angry' WHEN roi_side <> angry THEN 'neutral' END AS roi
        FROM (SELECT *, CASE WHEN x <= 860 THEN 'left' WHEN x >= 1060 THEN 'right' END AS roi_side
              FROM fixations)""",
    "first_dwells": """
        SELECT subject, paradigm, soa, angry, avg(CAST(roi = 'angry' AS INTEGER)) AS first_dwell_angry
        FROM (SELECT subject, trial, paradigm, soa, angry, arg_min(roi, start) FILTER (WHERE roi IS NOT NULL) AS roi
              FROM sided WHERE start > 0 GROUP BY ALL) GROUP BY ALL""",
    "masks": f"""
        SELECT roi_id, r AS row, c AS col,
          CASE WHEN (c <= 120) = (roi_id = 0) THEN 'diagnostic' ELSE 'non_diagnostic' END AS kind
        FROM range(2) AS a(roi_id), range(1, {MASK_ROWS + 1}) AS b(r), range(1, {MASK_COLS + 1}) AS d(c)
        WHERE c <= 120 OR c >= 281""",
    "placed": f"""
        SELECT f.subject, f.block, f.trial, f.trial % 2 AS roi_id, f.start - f.onset AS start,
          f."end" - f.onset AS "end",
          f.x - round_even(coalesce(o.x, m.x), 1) AS x_cent, f.y - round_even(coalesce(o.y, m.y), 1) AS y_cent
        FROM fixations f
        LEFT JOIN (SELECT * FROM flagged_baselines WHERE ok) o USING (subject, block, trial)
        LEFT JOIN (SELECT subject, block, round(avg(x), 9) AS x, round(avg(y), 9) AS y FROM flagged_baselines WHERE ok GROUP BY ALL) m
          USING (subject, block)""",
    "looked": f"""
        SELECT *, CASE WHEN in_roi THEN 'diagnostic' WHEN in_non THEN 'non-diagnostic' ELSE 'no ROI' END AS roi
        FROM (SELECT p.*, coalesce(k.kind = 'diagnostic', false) AS in_roi,
                coalesce(k.kind = 'non_diagnostic', false) AS in_non
              FROM placed p LEFT JOIN masks k ON k.roi_id = p.roi_id
                AND k.col = CAST(round_even(p.x_cent + 1.0 + {MASK_COLS / 2}, 0) AS BIGINT)
                AND k.row = CAST(round_even({1.0 + MASK_ROWS / 2} - p.y_cent, 0) AS BIGINT))""",
    "diff": """
        SELECT concat(CASE l_suppkey % 2 WHEN 0 THEN 'a' ELSE 'b' END,
                 CASE WHEN l_suppkey < 10 THEN '0' ELSE '' END, l_suppkey) AS subject,
          CASE l_suppkey % 2 WHEN 0 THEN 'Dot Probe' ELSE 'Dual Probe' END AS paradigm,
          l_linenumber AS trial, CASE l_linestatus WHEN 'F' THEN 'NA' ELSE 'AN' END AS angry,
          CASE WHEN l_linenumber % 2 = 0 THEN 'Even' ELSE 'Odd' END AS odd_even,
          CASE WHEN l_linestatus = 'F' THEN l_extendedprice / 10000 - l_quantity
               ELSE l_quantity - l_extendedprice / 10000 END AS n2pc,
          l_extendedprice / 10000 AS P7, l_quantity AS P8
        FROM lineitem""",
    "epoch_means": """
        SELECT subject, paradigm,
          avg(n2pc) FILTER (WHERE angry = 'AN') AS an, avg(n2pc) FILTER (WHERE angry = 'NA') AS na,
          avg(n2pc) FILTER (WHERE angry = 'AN' AND odd_even = 'Odd') AS an_odd,
          avg(n2pc) FILTER (WHERE angry = 'NA' AND odd_even = 'Odd') AS na_odd,
          avg(n2pc) FILTER (WHERE angry = 'AN' AND odd_even = 'Even') AS an_even,
          avg(n2pc) FILTER (WHERE angry = 'NA' AND odd_even = 'Even') AS na_even
        FROM diff GROUP BY ALL""",
    "impedances": """
        SELECT l_suppkey AS subject, concat('E', l_linenumber) AS electrode,
          CASE WHEN l_linestatus = 'F' THEN 'before' ELSE 'after' END AS time,
          CASE WHEN l_tax <> 0 THEN l_discount END AS impedance FROM lineitem""",
    "answers": """
        SELECT concat('q', vec_id) AS subject, label,
          list_transform(CAST(embedding AS DOUBLE[]), lambda v: CASE WHEN abs(v) >= 0.03 THEN v END)
            AS a FROM embeddings""",
}


#: The cleaning of gaze and the detection once more over recordings without trials.
_RECORDED = "interpolated merged samples speeds flags islands runs".split()


def _recorded(name: str) -> str:
    text = VIEWS[name].replace("subject, block, trial", "recording")
    for view in ["raw_samples", *_RECORDED]:
        text = re.sub(rf"\bFROM {view}\b", f"FROM rec_{view}", text)
    return text


VIEWS["rec_raw_samples"] = f"""
        SELECT left(subject, 1) AS recording, {", ".join(_FIELDS)},
          CAST(((CAST(substr(subject, 2) AS BIGINT) // 2) * 40 + (block - 1) * 20 + (trial - 1) % 20) * 640 + time AS DOUBLE) AS time
        FROM raw_samples"""
VIEWS |= {f"rec_{name}": _recorded(name) for name in _RECORDED}


def with_views(query: str) -> str:
    """The query with the views it needs, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(query)
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + query.strip()
