"""Plain SQL for the derived cohort and the curated tables, as named common table expressions."""

from __future__ import annotations

COHORT = """
cohort_base AS (
  SELECT l_orderkey AS okey, l_linenumber AS ln, l_partkey AS pkey, l_suppkey AS skey,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         strftime(l_shipdate, '%Y-%m-%d') AS day, l_partkey % 8 AS slot,
         (l_orderkey * 7 + l_partkey % 8 * 3) % 16 AS k, r_name AS center,
         p_brand, p_type, p_size AS size
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN region ON r_regionkey = (l_orderkey // 10) % 5
),
cohort_parts AS (
  SELECT *,
    CASE WHEN k < 8 THEN [1.0::DOUBLE, 0, 0, 0, 1, 0]
         WHEN k < 12 THEN [1.0::DOUBLE, 0, 0, 0, 0.96::DOUBLE, 0.28::DOUBLE]
         WHEN k = 12 THEN [0.0::DOUBLE, 1, 0, 0, 0, -1] WHEN k = 13 THEN [1.0::DOUBLE, 0, 0, 0, 0, -1]
         WHEN k = 15 THEN [1.0::DOUBLE, 0, 0, 0, 0.8::DOUBLE, 0.6::DOUBLE] END AS own_iop,
    CASE WHEN k = 12 THEN -40.0::DOUBLE ELSE 0.0::DOUBLE END AS sx,
    CASE WHEN k BETWEEN 8 AND 11 THEN -11.2::DOUBLE WHEN k = 13 THEN 40.0::DOUBLE
         WHEN k = 15 THEN -24.0::DOUBLE ELSE 0.0::DOUBLE END AS sy,
    CASE WHEN k BETWEEN 8 AND 11 THEN 38.4::DOUBLE WHEN k IN (12, 13) THEN 0.0::DOUBLE
         WHEN k = 15 THEN 32.0::DOUBLE ELSE 40.0::DOUBLE END AS sz,
    CASE WHEN NOT (slot = 7 AND okey % 97 = 0) THEN '1.2.840.' || okey || '.' || (slot + 1) END AS suid,
    'i' || ln || '_' || lpad(pkey::VARCHAR, 10, '0') || '_' || lpad(skey::VARCHAR, 10, '0') || '_'
      || lpad(cents::VARCHAR, 14, '0') || '_' || day || '.dcm' AS fname,
    CASE WHEN okey % 10 = 1 THEN okey - 1 ELSE okey END AS subj,
    [1.0::DOUBLE, 3.0::DOUBLE, 5.0::DOUBLE][(size % 3 + 1)::INT] AS thick
  FROM cohort_base
),
cohort_vectors AS (
  SELECT *, CASE WHEN ln = 7 AND k < 8 THEN [1.0::DOUBLE, 0, 0, 0, 0.96::DOUBLE, 0.28::DOUBLE]
                 WHEN ln = 7 THEN [1.0::DOUBLE, 0, 0, 0, 1, 0]
                 WHEN k = 14 AND ln % 2 = 0 THEN [0.0::DOUBLE, 0, 0, 0, 0, 0]
                 ELSE own_iop END AS any_iop,
            [sx * ln, sy * ln, sz * ln] AS p1, [sx * (ln + 0.5::DOUBLE), sy * (ln + 0.5::DOUBLE), sz * (ln + 0.5::DOUBLE)] AS p2
  FROM cohort_parts
),
cohort AS (
  SELECT center || '/' || CASE WHEN skey % 50 = 7 AND ln = 6 THEN 'o' || okey || '_'
           ELSE 'Sub_P' || lpad(subj::VARCHAR, 10, '0') || '/st' || okey || '/s' || slot
             || CASE WHEN skey % 9 = 0 THEN '/extra/' ELSE '/' END END || fname AS relpath,
    pkey % 101 <> 0 AS readable,
    CASE WHEN pkey % 103 = 0 THEN '' WHEN pkey % 107 = 0 THEN 'CT' ELSE 'MR' END AS modality,
    CASE WHEN okey % 89 <> 0 THEN '1.2.840.' || okey END AS study_uid,
    suid AS series_uid,
    CASE WHEN NOT (ln = 4 AND okey % 53 = 0) THEN suid || '.' || ln END AS sop_uid,
    CASE WHEN okey % 31 <> 0 THEN CAST(slot + 1 AS INT) END AS series_number,
    ['T1 MPRAGE', 't1w_bravo', 'T1 MPRAGE MPR', 'T2 FLAIR', 'Dark-Fluid', 'FLAIR derived',
     'Localizer', 'IR sequence'][slot + 1]
      || CASE WHEN slot = 4 AND size % 5 = 0 THEN ' MOTION' ELSE '' END AS series_description,
    'brain_p' || slot AS protocol_name,
    ['*fl3d1', '*fl3d1', '', '*spcir', '*tir2d', '', NULL, '*ir'][slot + 1] AS sequence_name,
    CASE WHEN slot = 7 AND okey % 6 = 0 THEN ['PRIMARY'] WHEN slot = 2 THEN ['DERIVED', 'SECONDARY', 'MPR']
         WHEN slot = 5 THEN ['DERIVED', 'SECONDARY'] ELSE ['ORIGINAL', 'PRIMARY', 'M'] END AS image_type,
    CASE WHEN size % 23 <> 0 THEN p_brand END AS manufacturer, p_type AS model_name,
    'V' || (size % 3) AS software_versions,
    CASE WHEN size % 2 = 0 THEN '3D' ELSE '2D' END AS acquisition_type,
    CASE WHEN slot <= 2 THEN 2000.0 WHEN slot <= 5 THEN 9000.0 WHEN slot = 6 THEN 20.0 ELSE 8000.5 END::DOUBLE AS repetition_time_ms,
    CASE WHEN slot <= 2 THEN 3.5 WHEN slot <= 5 THEN 120.0 WHEN slot = 6 THEN 5.0 ELSE 100.25 END::DOUBLE AS echo_time_ms,
    CASE WHEN slot <= 2 THEN 900.0 WHEN slot <= 5 THEN 2500.0 WHEN slot = 7 THEN 2200.0 END::DOUBLE AS inversion_time_ms,
    CASE WHEN slot <= 2 THEN 8.0 WHEN slot = 6 THEN 20.0 ELSE 150.0 END::DOUBLE AS flip_angle_deg,
    256 AS n_rows, 256 AS n_columns,
    CASE WHEN size % 29 = 0 THEN NULL WHEN size % 4 = 1 THEN [0.5::DOUBLE, 0.5::DOUBLE]
         ELSE [1.0::DOUBLE, 1.0::DOUBLE] END AS pixel_spacing,
    thick AS slice_thickness_mm,
    CASE WHEN size % 7 = 0 THEN thick + 1.0::DOUBLE ELSE thick END AS spacing_between_slices_mm,
    CASE WHEN ln <> 5 THEN any_iop END AS iop,
    CASE WHEN ln <> 5 AND NOT (ln = 3 AND okey % 11 = 0) THEN p1 END AS ipp,
    CASE WHEN ln = 5 AND any_iop IS NOT NULL THEN [any_iop] END AS frame_iops,
    CASE WHEN ln = 5 THEN [p1, p2] END AS frame_ipps
  FROM cohort_vectors
)"""

KEYED = COHORT + """,
located AS (
  SELECT *, len(string_split(relpath, '/')) AS depth, split_part(relpath, '/', 1) AS center,
    split_part(relpath, '/', 2) AS folder
  FROM cohort
),
labelled AS (
  SELECT *, regexp_replace(regexp_replace(lower(folder), '[^a-z0-9]', '', 'g'), '^sub(.)', '\\1') AS subject_id
  FROM located
),
keyed AS (
  SELECT *, coalesce(study_uid, 'missing-study:' || center || '/' || subject_id) AS study_key,
    coalesce(series_uid, 'missing-series:' || regexp_replace(relpath, '/[^/]*$', '')) AS series_key,
    coalesce(sop_uid, relpath) AS sop_key,
    CASE WHEN contains(relpath, '/extra/') THEN '1' ELSE '0' END || regexp_extract(relpath, '[^/]*$') AS walk
  FROM labelled WHERE depth >= 3 AND readable AND modality <> ''
)"""

SERIES = KEYED + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY center, subject_id, study_key, series_key, sop_key ORDER BY walk) AS copy_no
  FROM keyed
),
planes AS (
  SELECT center, subject_id, study_key, series_key, walk || '#0' AS place, iop, ipp FROM numbered WHERE copy_no = 1
  UNION ALL
  SELECT center, subject_id, study_key, series_key, walk || '#' || i, frame_iops[i], frame_ipps[i]
  FROM numbered, (SELECT unnest([1, 2]) AS i) WHERE copy_no = 1 AND i <= greatest(len(frame_iops), len(frame_ipps))
),
crossed AS (
  SELECT *, sqrt(iop[1]*iop[1] + iop[2]*iop[2] + iop[3]*iop[3]) AS rl,
    sqrt(iop[4]*iop[4] + iop[5]*iop[5] + iop[6]*iop[6]) AS cl,
    iop[2]*iop[6] - iop[3]*iop[5] AS cx, iop[3]*iop[4] - iop[1]*iop[6] AS cy,
    iop[1]*iop[5] - iop[2]*iop[4] AS cz
  FROM planes
),
measured AS (SELECT *, sqrt(cx*cx + cy*cy + cz*cz) AS nl FROM crossed),
normals AS (
  SELECT *, CASE WHEN rl >= 1e-8 AND cl >= 1e-8 AND nl >= rl * cl * 1e-8
                 THEN [cx / nl, cy / nl, cz / nl] END AS n
  FROM measured
),
representatives AS (
  SELECT center, subject_id, study_key, series_key,
    arg_min({'iop': iop, 'n': n}, place) FILTER (iop IS NOT NULL) AS rep,
    arg_min(n, place) FILTER (n IS NOT NULL) AS ref
  FROM normals GROUP BY ALL
),
geometry AS (
  SELECT center, subject_id, study_key, series_key, rep.iop AS iop, rep.n AS n,
    count(normals.n) AS n_normals,
    min(abs(normals.n[1]*ref[1] + normals.n[2]*ref[2] + normals.n[3]*ref[3])) AS cosine,
    max(ipp[1]*rep.n[1] + ipp[2]*rep.n[2] + ipp[3]*rep.n[3]) AS far,
    min(ipp[1]*rep.n[1] + ipp[2]*rep.n[2] + ipp[3]*rep.n[3]) AS near
  FROM (SELECT normals.* EXCLUDE (iop), rep, ref FROM normals
        JOIN representatives USING (center, subject_id, study_key, series_key)) AS normals
  GROUP BY ALL
),
firsts AS (
  SELECT center, subject_id, study_key, series_key, count(*) FILTER (copy_no = 1) AS instance_count,
    count(*) FILTER (copy_no > 1) AS duplicate_instance_count,
    arg_min({'series_number': series_number, 'modality': modality, 'series_description': series_description,
      'protocol_name': protocol_name, 'sequence_name': coalesce(sequence_name, ''), 'image_type': image_type,
      'manufacturer': coalesce(manufacturer, ''), 'model_name': model_name,
      'software_versions': software_versions, 'acquisition_type': acquisition_type,
      'repetition_time_ms': repetition_time_ms, 'echo_time_ms': echo_time_ms,
      'inversion_time_ms': inversion_time_ms, 'flip_angle_deg': flip_angle_deg,
      'pixel_spacing_mm': coalesce(pixel_spacing, []::DOUBLE[]), 'slice_thickness_mm': slice_thickness_mm,
      'spacing_between_slices_mm': spacing_between_slices_mm}, walk) AS a
  FROM numbered GROUP BY ALL
),
joined AS (
  SELECT center, subject_id, substr(sha256(study_key), 1, 16) AS study_uid_hash,
    substr(sha256(series_key), 1, 16) AS series_uid_hash, unnest(a), instance_count,
    duplicate_instance_count, iop, n,
    CASE WHEN n_normals >= 2 THEN degrees(acos(least(1.0, cosine))) WHEN n_normals = 1 THEN 0.0 END AS deviation,
    far, near
  FROM firsts JOIN geometry USING (center, subject_id, study_key, series_key)
),
flat AS (
  SELECT *, coalesce(deviation <= 3.0, true) AS orientation_consistent,
    CASE WHEN n IS NULL THEN 'unknown' WHEN abs(n[1]) >= abs(n[2]) AND abs(n[1]) >= abs(n[3]) THEN 'sagittal'
         WHEN abs(n[2]) >= abs(n[3]) THEN 'coronal' ELSE 'axial' END AS nearest_plane,
    CASE WHEN n IS NOT NULL THEN degrees(acos(least(1.0, greatest(abs(n[1]), abs(n[2]), abs(n[3]))))) END AS plane_angle_deg,
    far - near + greatest(coalesce(slice_thickness_mm, 0.0), 0.0) AS coverage_mm,
    ' ' || trim(regexp_replace(lower(series_description || ' ' || protocol_name || ' ' || sequence_name
      || ' ' || array_to_string(image_type, ' ')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS words,
    ' ' || trim(regexp_replace(lower(series_description || ' ' || protocol_name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS short_words
  FROM joined
),
named AS (
  SELECT *, CASE WHEN NOT orientation_consistent THEN 'inconsistent'
      WHEN plane_angle_deg > 20.0 THEN 'oblique' ELSE nearest_plane END AS plane,
    concat_ws(';', CASE WHEN iop IS NULL THEN 'missing_orientation' END,
      CASE WHEN NOT orientation_consistent THEN 'orientation_deviation=' || printf('%.3f', deviation) END) AS inventory_note,
    regexp_matches(words, ' (localizer|scout|survey|screensave|screen save|mip|minip|phoenixzip) ') AS has_excluded,
    regexp_matches(words, ' (flair|t2flair|t2 flair|darkfluid|dark fluid|fluid attenuated) ') AS has_flair,
    regexp_matches(words, ' (t1|t1w|et1w|mprage|bravo|spgr|tfl3d|t1seg) ') AS has_t1,
    regexp_matches(words, ' (t1 flair|t1flair) ') AS has_t1_flair,
    coalesce(repetition_time_ms >= 4000 AND echo_time_ms >= 60 AND inversion_time_ms >= 1200, false) AS timed,
    CASE WHEN regexp_matches(short_words, ' (mpr|reformat|reformatted) ') THEN 'derived_mpr'
      WHEN list_contains(image_type, 'ORIGINAL') AND list_contains(image_type, 'PRIMARY') THEN 'original'
      WHEN list_contains(image_type, 'DERIVED') OR list_contains(image_type, 'SECONDARY') THEN 'derived'
      ELSE 'unknown' END AS source_kind
  FROM flat
),
typed AS (
  SELECT *, CASE WHEN upper(modality) <> 'MR' OR has_excluded THEN 'other'
      WHEN has_flair AND NOT has_t1_flair THEN 'flair' WHEN timed AND NOT has_t1 THEN 'flair'
      WHEN has_t1 AND NOT has_flair THEN 't1' ELSE 'other' END AS candidate_type,
    CASE WHEN has_excluded THEN 'high' WHEN upper(modality) <> 'MR' THEN 'low'
      WHEN has_flair AND NOT has_t1_flair THEN 'high' WHEN timed AND NOT has_t1 THEN 'medium'
      WHEN has_t1 AND NOT has_flair THEN 'high' ELSE 'low' END AS classification_confidence
  FROM named
),
series AS (
  SELECT *, candidate_type || '-' || substr(sha256(concat_ws('|', candidate_type, lower(trim(manufacturer)),
      lower(trim(model_name)), lower(trim(software_versions)), upper(trim(acquisition_type)),
      coalesce(printf('%.4f', repetition_time_ms), ''), coalesce(printf('%.4f', echo_time_ms), ''),
      coalesce(printf('%.4f', inversion_time_ms), ''), coalesce(printf('%.4f', flip_angle_deg), ''),
      coalesce(printf('%.4f', slice_thickness_mm), ''), coalesce(printf('%.4f', spacing_between_slices_mm), ''),
      CASE WHEN len(pixel_spacing_mm) = 2 THEN printf('%.4f', pixel_spacing_mm[1]) || 'x' || printf('%.4f', pixel_spacing_mm[2]) ELSE '' END
    )), 1, 10) AS protocol_id
  FROM typed
)"""

SCORES = SERIES + """,
volumes AS (
  SELECT *, CASE WHEN len(pixel_spacing_mm) = 2 AND slice_thickness_mm > 0
    THEN pixel_spacing_mm[1] * pixel_spacing_mm[2] * slice_thickness_mm END AS volume,
    spacing_between_slices_mm - slice_thickness_mm AS gap
  FROM series
),
scores AS (
  SELECT *, CASE candidate_type WHEN 't1' THEN
      CASE source_kind WHEN 'original' THEN 100.0::DOUBLE WHEN 'derived_mpr' THEN 65.0 WHEN 'unknown' THEN 25.0 ELSE 5.0 END
      + CASE WHEN acquisition_type = '3D' THEN 15.0 ELSE 0.0 END
      + CASE WHEN coverage_mm IS NULL THEN 0.0 ELSE least(30.0::DOUBLE, coverage_mm / 5.0::DOUBLE) END
      - CASE WHEN coverage_mm < 100.0 THEN 30.0 ELSE 0.0 END
      + CASE WHEN volume IS NULL THEN 0.0 ELSE least(25.0::DOUBLE, 20.0::DOUBLE / greatest(volume, 0.1::DOUBLE)) END
      - CASE WHEN orientation_consistent THEN 0.0 ELSE 100.0 END
    WHEN 'flair' THEN
      CASE source_kind WHEN 'original' THEN 60.0::DOUBLE WHEN 'unknown' THEN 25.0 WHEN 'derived' THEN 5.0 ELSE 10.0 END
      + CASE WHEN acquisition_type = '3D' THEN 35.0 WHEN acquisition_type = '2D' AND plane = 'axial' THEN 15.0 ELSE 0.0 END
      + CASE WHEN coverage_mm IS NULL THEN 0.0 WHEN coverage_mm >= 100.0 THEN 30.0 ELSE -40.0 END
      + CASE WHEN volume IS NULL THEN 0.0 ELSE least(35.0::DOUBLE, 28.0::DOUBLE / greatest(volume, 0.1::DOUBLE)) END
      + CASE WHEN slice_thickness_mm IS NULL THEN 0.0 WHEN slice_thickness_mm <= 1.5 THEN 20.0
             WHEN slice_thickness_mm <= 3 THEN 12.0 WHEN slice_thickness_mm <= 5 THEN 4.0 ELSE -15.0 END
      + CASE WHEN gap IS NULL THEN 0.0 WHEN gap <= 0.5 THEN 8.0 ELSE -least(20.0::DOUBLE, gap * 4.0) END
      - CASE WHEN classification_confidence = 'medium' THEN 5.0 ELSE 0.0 END
      - CASE WHEN regexp_matches(words, ' (motion|repeat|failed|artifact|moco) ') THEN 40.0 ELSE 0.0 END
      - CASE WHEN orientation_consistent THEN 0.0 ELSE 100.0 END
    ELSE 0.0 END AS score
  FROM volumes
)"""

SELECTION = SCORES + """,
pooled AS (
  SELECT *, max((candidate_type = 't1' AND plane = 'axial' AND source_kind = 'original')::INT) OVER (PARTITION BY subject_id) AS any_original,
    min(study_uid_hash) OVER (PARTITION BY subject_id) <> max(study_uid_hash) OVER (PARTITION BY subject_id) AS multi
  FROM scores
),
marked AS (
  SELECT *, candidate_type = 't1' AND plane = 'axial'
      AND source_kind = CASE WHEN any_original = 1 THEN 'original' ELSE 'derived_mpr' END AS in_pool
  FROM pooled
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id, candidate_type, in_pool ORDER BY score DESC, series_uid_hash) AS place
  FROM marked
),
tops AS (
  SELECT *, max(score) FILTER (in_pool) OVER (PARTITION BY subject_id, candidate_type) AS t1_top,
    max(score) FILTER (in_pool AND place = 2) OVER (PARTITION BY subject_id, candidate_type) AS t1_second,
    max(score) FILTER (place = 1) OVER (PARTITION BY subject_id, candidate_type) AS fl_top,
    max(score) FILTER (place = 2) OVER (PARTITION BY subject_id, candidate_type) AS fl_second,
    bool_and(classification_confidence = 'high' AND orientation_consistent) FILTER (place = 1)
      OVER (PARTITION BY subject_id, candidate_type) AS fl_sure
  FROM ranked
),
reasons AS (
  SELECT *, CASE WHEN candidate_type = 'other' THEN 'not_t1_or_flair' WHEN multi THEN 'multiple_studies'
      WHEN candidate_type = 't1' THEN
        CASE WHEN t1_top IS NULL THEN 'no_reliable_axial_t1'
             WHEN coalesce(t1_top - t1_second <= 5.0, false) THEN
               CASE WHEN in_pool AND t1_top - score <= 5.0 THEN 't1_near_tie' ELSE 'lower_ranked_t1' END
             WHEN in_pool AND place = 1 THEN
               CASE WHEN source_kind = 'original' THEN 'best_original_axial_t1' ELSE 'axial_mpr_fallback' END
             ELSE 'lower_ranked_t1' END
      WHEN NOT fl_sure THEN CASE WHEN place = 1 THEN 'flair_low_confidence' ELSE 'lower_ranked_flair' END
      WHEN coalesce(fl_top - fl_second <= 5.0, false) THEN
        CASE WHEN place <= 2 THEN 'flair_near_tie' ELSE 'lower_ranked_flair' END
      WHEN place = 1 THEN 'best_wmh_flair' ELSE 'lower_ranked_flair' END AS reason
  FROM tops
),
selection AS (
  SELECT *, CASE WHEN reason IN ('best_original_axial_t1', 'axial_mpr_fallback', 'best_wmh_flair') THEN 'selected'
      WHEN reason IN ('multiple_studies', 'no_reliable_axial_t1', 't1_near_tie', 'flair_low_confidence', 'flair_near_tie') THEN 'review'
      ELSE 'excluded' END AS decision_status,
    CASE WHEN reason = 'axial_mpr_fallback' THEN 'sub-' || subject_id || '_rec-axialmpr_T1w'
      WHEN reason = 'best_original_axial_t1' THEN 'sub-' || subject_id || '_T1w'
      WHEN reason = 'best_wmh_flair' THEN 'sub-' || subject_id || '_FLAIR' ELSE '' END AS output_basename
  FROM reasons
)"""

# A decision sheet written over the selection: the series with the greatest hash of every subject
# and type is decided by the last digit of its hash; an earlier line about it is overruled.
SHEET = SELECTION + """,
decidable AS (
  SELECT *, right(series_uid_hash, 1) AS d FROM (
    SELECT *, max(series_uid_hash) OVER (PARTITION BY subject_id, candidate_type) AS greatest_hash,
      min(series_uid_hash) OVER (PARTITION BY subject_id, candidate_type) AS least_hash
    FROM selection WHERE candidate_type <> 'other')
),
sheet AS (
  SELECT subject_id, study_uid_hash, series_uid_hash, candidate_type, source_kind,
    CASE WHEN d IN ('0', '1', '2') THEN CASE WHEN candidate_type = 'flair' THEN 'accept_flair'
        WHEN source_kind = 'original' THEN 'accept_original' WHEN source_kind = 'derived_mpr' THEN 'accept_mpr'
        ELSE 'accept_sag_fallback' END
      WHEN d = '3' THEN 'exclude' END AS decision
  FROM decidable WHERE series_uid_hash = greatest_hash AND d IN ('0', '1', '2', '3')
),
accepted AS (
  SELECT subject_id, candidate_type, min(series_uid_hash) AS winner FROM sheet
  WHERE decision <> 'exclude' GROUP BY ALL
),
final_selection AS (
  SELECT s.* REPLACE (
      CASE WHEN s.series_uid_hash <> winner OR decision = 'exclude' THEN 'excluded'
           WHEN decision IS NOT NULL THEN 'selected' ELSE decision_status END AS decision_status,
      CASE WHEN s.series_uid_hash <> winner THEN 'superseded_by_manual_selection'
           WHEN decision = 'exclude' THEN 'manual_exclusion'
           WHEN decision IS NOT NULL THEN 'manual_' || decision ELSE reason END AS reason,
      CASE WHEN s.series_uid_hash <> winner OR decision = 'exclude' THEN ''
           WHEN decision = 'accept_flair' THEN 'sub-' || s.subject_id || '_FLAIR'
           WHEN decision = 'accept_mpr' THEN 'sub-' || s.subject_id || '_rec-axialmpr_T1w'
           WHEN decision = 'accept_sag_fallback' THEN 'sub-' || s.subject_id || '_acq-manualsag_T1w'
           WHEN decision IS NOT NULL THEN 'sub-' || s.subject_id || '_T1w' ELSE output_basename END AS output_basename),
    coalesce(decision, '') AS manual_decision,
    CASE WHEN decision IS NULL THEN '' ELSE 'rev_' || left(s.series_uid_hash, 1) END AS reviewer
  FROM selection s
  LEFT JOIN sheet ON s.subject_id = sheet.subject_id AND s.study_uid_hash = sheet.study_uid_hash
    AND s.series_uid_hash = sheet.series_uid_hash
  LEFT JOIN accepted ON s.subject_id = accepted.subject_id AND s.candidate_type = accepted.candidate_type
)"""

STAGES = """
lifecycle AS (
  SELECT event_id, ts, 'u' || user_id AS series_uid_hash, value,
    CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'linking' WHEN 'click' THEN 'dcm2niix'
      WHEN 'purchase' THEN 'converted' ELSE 'failed' END AS stage
  FROM events
),
latest AS (
  SELECT * FROM lifecycle
  QUALIFY row_number() OVER (PARTITION BY series_uid_hash ORDER BY ts DESC, event_id DESC) = 1
)"""


def query(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"
