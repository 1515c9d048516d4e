"""SQL twins of the derived tables, for an engine other than Spark: what they take, and a text that tells the same table by joins and filters."""

from __future__ import annotations

from tessera.concepts import bedside, comorbidity, elixhauser, firstday, infection, infusions, measurements, prescriptions, scores, severity

TWINS: dict[str, tuple[tuple[str, ...], str]] = {}


def twin(name: str, inputs: str, text: str) -> None:
    TWINS[name] = (tuple(inputs.split()), text)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def _top(codes: tuple, name: str, guard: str = "", value: str = "valuenum", agg: str = "max") -> str:
    return f"{agg}({value}) FILTER (WHERE itemid IN {_in(codes)}{' AND ' + guard if guard else ''}) AS {name}"


def _specimens(columns: list[str], codes: list, where: str = "true") -> str:
    return f"SELECT max(subject_id) AS subject_id, max(hadm_id) AS hadm_id, max(charttime) AS charttime, specimen_id, {', '.join(columns)} FROM labevents WHERE valuenum IS NOT NULL AND itemid IN {_in(codes)} AND {where} GROUP BY specimen_id"


for _name, _codes, _where in (
    ("complete_blood_count", measurements.BLOOD_COUNT, "valuenum > 0"), ("coagulation", measurements.COAGULATION, "true"), ("enzyme", measurements.ENZYME, "valuenum > 0"),
    ("cardiac_marker", measurements.CARDIAC_MARKER, "true"), ("inflammation", measurements.INFLAMMATION, "valuenum > 0"),
):
    twin(_name, "labevents", _specimens([_top((c,), n) for n, c in _codes.items()], list(_codes.values()), _where))
twin("chemistry", "labevents", _specimens([_top((c,), n, f"valuenum <= {high}") for n, (c, high) in measurements.CHEMISTRY.items()], [c for c, _ in measurements.CHEMISTRY.values()], "(valuenum > 0 OR itemid = 50868)"))
_cells = {f"{n}_abs": c for n, c in measurements.ABSOLUTE.items()} | measurements.PERCENT | measurements.OTHER_CELLS
_shares = _in(x for c in measurements.PERCENT.values() for x in c)
_all_cells = [*measurements.WHITE_CELLS, measurements.GRANULOCYTES, *[x for c in _cells.values() for x in c]]
twin(
    "blood_differential", "labevents",
    f"""WITH e AS (SELECT * REPLACE (CASE WHEN itemid IN {_in(measurements.PER_MICROLITRE)} THEN valuenum / 1000.0 ELSE valuenum END AS valuenum) FROM labevents WHERE valuenum >= 0),
p AS ({_specimens([_top(measurements.WHITE_CELLS, "wbc"), *[_top(c, n) for n, c in _cells.items()], f"sum(valuenum) FILTER (WHERE itemid IN {_shares}) AS shares"], _all_cells).replace("FROM labevents", "FROM e")})
SELECT subject_id, hadm_id, charttime, specimen_id, wbc, {", ".join(f"round(TRY_CAST(coalesce({n}_abs, CASE WHEN wbc > 0 AND shares > 0 THEN {n} * wbc / 100 END) AS DECIMAL(18, 3)), 4) AS {n}_abs" for n in measurements.ABSOLUTE)},
{", ".join([*measurements.PERCENT, *measurements.OTHER_CELLS])} FROM p""",
)
twin("rhythm", "chartevents", f"SELECT subject_id, charttime, {', '.join(_top((c,), n, value='value') for n, c in measurements.RHYTHM.items())} FROM chartevents WHERE stay_id IS NOT NULL AND itemid IN {_in(measurements.RHYTHM.values())} GROUP BY 1, 2")
_vent = [_top(c, n, {"fio2": "", "peep": "valuenum BETWEEN 0 AND 100"}.get(n, ""), "CASE WHEN valuenum BETWEEN 0.2 AND 1 THEN valuenum * 100 WHEN valuenum BETWEEN 20 AND 100 THEN valuenum END" if n == "fio2" else "valuenum") for n, c in measurements.VENTILATOR_NUMBERS.items()]
_vent += [_top((c,), n, value="value") for n, c in measurements.VENTILATOR_TEXTS.items()]
_vent_codes = [x for c in measurements.VENTILATOR_NUMBERS.values() for x in c] + list(measurements.VENTILATOR_TEXTS.values())
twin("ventilator_setting", "chartevents", f"SELECT subject_id, max(stay_id) AS stay_id, charttime, {', '.join(_vent)} FROM chartevents WHERE value IS NOT NULL AND stay_id IS NOT NULL AND itemid IN {_in(_vent_codes)} GROUP BY 1, 3")
_vitals = [_top(c, n, f"valuenum > 0 AND valuenum < {high}", agg="avg") for n, (c, high) in measurements.VITALS.items()]
_vital_codes = sorted({x for c, _ in measurements.VITALS.values() for x in c} | {223761, 223762, 224642, 220277, 225664, 220621, 226537})
twin(
    "vitalsign", "chartevents",
    f"""SELECT subject_id, stay_id, charttime, {", ".join(_vitals)},
round(TRY_CAST(avg(CASE WHEN itemid = 223761 AND valuenum > 70 AND valuenum < 120 THEN (valuenum - 32) / 1.8 WHEN itemid = 223762 AND valuenum > 10 AND valuenum < 50 THEN valuenum END) AS DECIMAL(18, 3)), 2) AS temperature,
{_top((224642,), "temperature_site", value="value")}, {_top((220277,), "spo2", "valuenum > 0 AND valuenum <= 100", agg="avg")}, {_top((225664, 220621, 226537), "glucose", "valuenum > 0", agg="avg")}
FROM chartevents WHERE stay_id IS NOT NULL AND itemid IN {_in(_vital_codes)} GROUP BY 1, 2, 3""",
)
twin("icp", "chartevents", f"SELECT subject_id, stay_id, charttime, {_top(measurements.PRESSURE_IN_SKULL, 'icp', 'valuenum > 0 AND valuenum < 100')} FROM chartevents WHERE itemid IN {_in(measurements.PRESSURE_IN_SKULL)} GROUP BY 1, 2, 3")
twin(
    "height", "chartevents",
    """WITH c AS (SELECT * FROM chartevents WHERE itemid = 226730 AND valuenum IS NOT NULL), i AS (SELECT * FROM chartevents WHERE itemid = 226707 AND valuenum IS NOT NULL),
m AS (SELECT c.subject_id, c.stay_id, c.charttime, coalesce(round(CAST(c.valuenum AS DECIMAL(18, 3)), 2), round(CAST(i.valuenum * 2.54 AS DECIMAL(18, 3)), 2)) AS height FROM c FULL JOIN i ON c.subject_id = i.subject_id AND c.charttime = i.charttime)
SELECT * FROM m WHERE height > 120 AND height < 230""",
)
twin("urine_output", "outputevents", f"SELECT stay_id, charttime, sum(value * CASE WHEN itemid = 227488 AND value > 0 THEN -1 ELSE 1 END) AS urineoutput FROM outputevents WHERE itemid IN {_in(measurements.URINE)} GROUP BY 1, 2")
twin("icustay_times", "chartevents icustays", "SELECT s.subject_id, s.hadm_id, s.stay_id, min(charttime) AS intime_hr, max(charttime) AS outtime_hr FROM icustays s LEFT JOIN chartevents c ON c.stay_id = s.stay_id AND itemid = 220045 GROUP BY 1, 2, 3")
twin(
    "icustay_hourly", "icustay_times",
    """SELECT stay_id, hr, date_trunc('hour', intime_hr + INTERVAL 59 MINUTE + INTERVAL 59 SECOND) + hr * INTERVAL 1 HOUR AS endtime
FROM (SELECT *, unnest(generate_series(-24, CAST(ceil((epoch_us(outtime_hr) - epoch_us(intime_hr)) / 3.6e9) AS BIGINT))) AS hr FROM icustay_times WHERE intime_hr IS NOT NULL)""",
)
twin("age", "admissions patients", "SELECT a.subject_id, hadm_id, admittime, anchor_age, anchor_year, anchor_age + (epoch_us(admittime) - epoch_us(make_timestamp(anchor_year, 1, 1, 0, 0, 0))) / 31556908800000.0 AS age FROM admissions a JOIN patients p ON a.subject_id = p.subject_id")
twin(
    "kdigo_creatinine", "labevents icustays",
    """WITH m AS (SELECT s.hadm_id, s.stay_id, charttime, avg(valuenum) AS creat FROM icustays s LEFT JOIN labevents l ON l.subject_id = s.subject_id AND itemid = 50912 AND valuenum <= 150
  AND charttime BETWEEN intime - INTERVAL 7 DAY AND outtime GROUP BY 1, 2, 3)
SELECT m.*, (SELECT min(e.creat) FROM m e WHERE e.stay_id = m.stay_id AND e.charttime < m.charttime AND e.charttime >= m.charttime - INTERVAL 48 HOUR) AS creat_low_past_48hr,
  (SELECT min(e.creat) FROM m e WHERE e.stay_id = m.stay_id AND e.charttime < m.charttime AND e.charttime >= m.charttime - INTERVAL 7 DAY) AS creat_low_past_7day FROM m""",
)
for _agent, _code in infusions.AGENTS.items():
    _rate = {
        "norepinephrine": "CASE WHEN rateuom = 'mg/kg/min' AND patientweight IS DISTINCT FROM 1 THEN rate * 1000.0 ELSE rate END", "phenylephrine": "CASE WHEN rateuom = 'mcg/min' THEN rate / nullif(patientweight, 0) ELSE rate END",
        "vasopressin": "CASE WHEN rateuom = 'units/min' THEN rate * 60.0 ELSE rate END",
    }.get(_agent, "rate")
    twin(_agent, "inputevents", f"SELECT stay_id, linkorderid, {_rate} AS vaso_rate, amount AS vaso_amount, starttime, endtime FROM inputevents WHERE itemid = {_code}")
twin("neuroblock", "inputevents", f"SELECT stay_id, orderid, rate AS drug_rate, amount AS drug_amount, starttime, endtime FROM inputevents WHERE rate IS NOT NULL AND itemid IN {_in(infusions.BLOCKERS)}")
_covered = " ".join(f"LEFT JOIN {a} ON {a}.stay_id = g.stay_id AND {a}.starttime <= g.starttime AND {a}.endtime >= g.endtime" for a in infusions.AGENTS)
twin(
    "vasoactive_agent", " ".join(infusions.AGENTS),
    f"""WITH t AS ({" UNION ".join(f"SELECT stay_id, {c} AS t FROM {a}" for a in infusions.AGENTS for c in ("starttime", "endtime"))}),
g AS (SELECT stay_id, t AS starttime, lead(t) OVER (PARTITION BY stay_id ORDER BY t) AS endtime FROM t)
SELECT g.stay_id, g.starttime, g.endtime, {", ".join(f"{a}.vaso_rate AS {a}" for a in infusions.AGENTS)} FROM g {_covered} WHERE g.endtime IS NOT NULL""",
)
twin(
    "norepinephrine_equivalent_dose", "vasoactive_agent",
    """SELECT stay_id, starttime, endtime, round(CAST(coalesce(norepinephrine, 0.0) + coalesce(epinephrine, 0.0) + coalesce(phenylephrine / 10, 0.0) + coalesce(dopamine / 100, 0.0) + coalesce(vasopressin * 2.5 / 60, 0.0) AS DECIMAL(18, 3)), 4)
  AS norepinephrine_equivalent_dose FROM vasoactive_agent WHERE NOT (norepinephrine IS NULL AND epinephrine IS NULL AND phenylephrine IS NULL AND dopamine IS NULL AND vasopressin IS NULL)""",
)
for _name, _terms in (("acei", prescriptions.ACE_INHIBITORS), ("nsaid", prescriptions.NSAIDS)):
    twin(_name, "prescriptions", f"SELECT subject_id, hadm_id, drug AS {_name}, starttime, stoptime FROM prescriptions WHERE " + " OR ".join(f"upper(drug) LIKE '%{t}%'" for t in _terms))

# ---- the bedside record ----
twin(
    "weight_durations", "chartevents icustays",
    """WITH w AS (SELECT c.stay_id, charttime, CASE itemid WHEN 226512 THEN 'admit' ELSE 'daily' END AS weight_type, valuenum AS weight, intime, outtime FROM chartevents c JOIN icustays s ON c.stay_id = s.stay_id
  WHERE itemid IN (226512, 224639) AND valuenum > 0),
b AS (SELECT *, CASE WHEN weight_type = 'admit' AND row_number() OVER (PARTITION BY stay_id, weight_type ORDER BY charttime, weight) = 1 THEN intime - INTERVAL 2 HOUR ELSE charttime END AS starttime FROM w),
s AS (SELECT *, coalesce(lead(starttime) OVER o, outtime + INTERVAL 2 HOUR) AS endtime, row_number() OVER o AS place FROM b WINDOW o AS (PARTITION BY stay_id ORDER BY starttime, weight_type, weight))
SELECT stay_id, starttime, endtime, weight, weight_type FROM s UNION ALL SELECT stay_id, intime - INTERVAL 2 HOUR, starttime, weight, weight_type FROM s WHERE place = 1 AND starttime > intime""",
)
_gas = [_top((c,), n, f"valuenum <= {high}" if high else "") for n, (c, high) in bedside.GAS.items()]
_gas_codes = [c for c, _ in bedside.GAS.values()] + [bedside.SPECIMEN, bedside.GAS_FIO2]
twin(
    "bg", "labevents chartevents",
    f"""WITH g AS (SELECT specimen_id, max(subject_id) AS subject_id, max(hadm_id) AS hadm_id, max(charttime) AS charttime, {_top((bedside.SPECIMEN,), "specimen", value="value")}, {", ".join(_gas)},
  {_top((bedside.GAS_FIO2,), "fio2", value="CASE WHEN valuenum > 20 AND valuenum <= 100 THEN valuenum WHEN valuenum > 0.2 AND valuenum <= 1.0 THEN valuenum * 100 END")}
  FROM labevents WHERE itemid IN {_in(_gas_codes)} GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY subject_id, charttime ORDER BY specimen_id) AS nth FROM g WHERE po2 IS NOT NULL),
f AS (SELECT subject_id, charttime AS seen, max(CASE WHEN valuenum > 0.2 AND valuenum <= 1 THEN valuenum * 100 WHEN valuenum >= 20 AND valuenum <= 100 THEN valuenum END) AS share FROM chartevents WHERE itemid = {bedside.CHART_FIO2} GROUP BY 1, 2),
j AS (SELECT o.*, (SELECT max_by(share, seen) FROM f WHERE f.subject_id = o.subject_id AND share > 0 AND seen BETWEEN o.charttime - INTERVAL 4 HOUR AND o.charttime) AS fio2_chartevents FROM o WHERE nth = 1)
SELECT subject_id, hadm_id, charttime, specimen, so2, po2, pco2, fio2_chartevents, fio2, aado2, coalesce(fio2, fio2_chartevents) / 100 * 713 - pco2 / 0.8 - po2 AS aado2_calc, 100 * po2 / coalesce(fio2, fio2_chartevents) AS pao2fio2ratio,
  ph, baseexcess, bicarbonate, totalco2, hematocrit, hemoglobin, carboxyhemoglobin, methemoglobin, chloride, calcium, temperature, potassium, sodium, lactate, glucose FROM j""",
)
twin(
    "gcs", "chartevents",
    """WITH b AS (SELECT subject_id, stay_id, charttime, max(valuenum) FILTER (WHERE itemid = 223901) AS m, max(CASE WHEN value = 'No Response-ETT' THEN 0 ELSE valuenum END) FILTER (WHERE itemid = 223900) AS v,
  max(valuenum) FILTER (WHERE itemid = 220739) AS e, max(CASE WHEN itemid = 223900 AND value = 'No Response-ETT' THEN 1 ELSE 0 END) AS u FROM chartevents WHERE itemid IN (223900, 223901, 220739) GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY charttime) AS r FROM b),
p AS (SELECT n.*, q.m AS pm, q.v AS pv, q.e AS pe FROM n LEFT JOIN n q ON q.stay_id = n.stay_id AND q.r = n.r - 1 AND q.charttime > n.charttime - INTERVAL 6 HOUR)
SELECT subject_id, stay_id, charttime, CASE WHEN v = 0 OR (v IS NULL AND pv = 0) THEN 15 WHEN pv = 0 THEN coalesce(m, 6) + coalesce(v, 5) + coalesce(e, 4) ELSE coalesce(m, pm, 6) + coalesce(v, pv, 5) + coalesce(e, pe, 4) END AS gcs,
  coalesce(m, pm) AS gcs_motor, coalesce(v, pv) AS gcs_verbal, coalesce(e, pe) AS gcs_eyes, u AS gcs_unable FROM p""",
)
twin(
    "oxygen_delivery", "chartevents",
    """WITH f AS (SELECT subject_id, stay_id, charttime, CASE WHEN itemid = 227287 THEN 2 ELSE 1 END AS kind, valuenum, row_number() OVER (PARTITION BY subject_id, charttime, itemid = 227287 ORDER BY storetime DESC, valuenum DESC) AS nth
  FROM chartevents WHERE value IS NOT NULL AND itemid IN (223834, 227582, 227287)),
d AS (SELECT subject_id, charttime, value, row_number() OVER (PARTITION BY subject_id, charttime ORDER BY value NULLS FIRST) AS place FROM chartevents WHERE itemid = 226732)
SELECT f.subject_id, max(stay_id) AS stay_id, f.charttime, max(valuenum) FILTER (WHERE kind = 1) AS o2_flow, max(valuenum) FILTER (WHERE kind = 2) AS o2_flow_additional, max(value) FILTER (WHERE place = 1) AS o2_delivery_device_1,
  max(value) FILTER (WHERE place = 2) AS o2_delivery_device_2, max(value) FILTER (WHERE place = 3) AS o2_delivery_device_3, max(value) FILTER (WHERE place = 4) AS o2_delivery_device_4
FROM f LEFT JOIN d ON f.subject_id = d.subject_id AND f.charttime = d.charttime WHERE nth = 1 GROUP BY 1, 3""",
)
twin(
    "ventilation", "ventilator_setting oxygen_delivery",
    f"""WITH k AS (SELECT stay_id, charttime FROM ventilator_setting UNION SELECT stay_id, charttime FROM oxygen_delivery),
c AS (SELECT k.stay_id, k.charttime, CASE WHEN o2_delivery_device_1 IN {_in(bedside.TRACHEOSTOMY)} THEN 'Tracheostomy'
  WHEN o2_delivery_device_1 IN {_in(bedside.TUBE)} OR ventilator_mode IN {_in(bedside.INVASIVE_MODES)} OR ventilator_mode_hamilton IN {_in(bedside.INVASIVE_HAMILTON)} THEN 'InvasiveVent'
  WHEN o2_delivery_device_1 IN {_in(bedside.MASKS)} OR ventilator_mode_hamilton IN {_in(bedside.NONINVASIVE_HAMILTON)} THEN 'NonInvasiveVent' WHEN o2_delivery_device_1 IN {_in(bedside.HIGH_FLOW)} THEN 'HFNC'
  WHEN o2_delivery_device_1 IN {_in(bedside.SUPPLEMENTAL)} THEN 'SupplementalOxygen' WHEN o2_delivery_device_1 = 'None' THEN 'None' END AS s
  FROM k LEFT JOIN ventilator_setting v ON v.stay_id = k.stay_id AND v.charttime = k.charttime LEFT JOIN oxygen_delivery o ON o.stay_id = k.stay_id AND o.charttime = k.charttime),
l AS (SELECT *, lead(charttime) OVER w AS nxt, lag(s) OVER w AS ps, lag(charttime) OVER (PARTITION BY stay_id, s ORDER BY charttime) AS pt FROM c WHERE s IS NOT NULL WINDOW w AS (PARTITION BY stay_id ORDER BY charttime)),
e AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> s OR epoch_us(charttime) - epoch_us(pt) >= 50400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY stay_id ORDER BY charttime) AS episode FROM l)
SELECT stay_id, min(charttime) AS starttime, max(CASE WHEN epoch_us(nxt) - epoch_us(charttime) < 50400000000 THEN nxt ELSE charttime END) AS endtime, max(s) AS ventilation_status FROM e GROUP BY stay_id, episode HAVING count(DISTINCT charttime) > 1""",
)
_tm = {"6hr": 5, "12hr": 11, "24hr": 23}
twin(
    "urine_output_rate", "urine_output weight_durations chartevents icustays",
    f"""WITH h AS (SELECT s.stay_id, min(charttime) AS t0 FROM icustays s JOIN chartevents c ON c.stay_id = s.stay_id AND itemid = 220045 AND charttime > intime - INTERVAL 1 MONTH AND charttime < outtime + INTERVAL 1 MONTH GROUP BY 1),
u AS (SELECT u.stay_id, charttime, urineoutput, (epoch_us(charttime) - epoch_us(coalesce(lag(charttime) OVER (PARTITION BY u.stay_id ORDER BY charttime), t0))) / 6e7 AS m FROM urine_output u JOIN h ON h.stay_id = u.stay_id),
r AS (SELECT a.stay_id, a.charttime, any_value(a.urineoutput) AS uo, {", ".join(f"sum(b.urineoutput) FILTER (WHERE a.charttime <= b.charttime + INTERVAL {n} HOUR) AS o{s}, sum(b.m) FILTER (WHERE a.charttime <= b.charttime + INTERVAL {n} HOUR) / 60 AS h{s}" for s, n in _tm.items())}
  FROM u a JOIN u b ON a.stay_id = b.stay_id AND b.charttime <= a.charttime AND a.charttime <= b.charttime + INTERVAL 23 HOUR GROUP BY 1, 2)
SELECT r.stay_id, r.charttime, weight, uo, {", ".join(f"o{s} AS urineoutput_{s}" for s in _tm)}, {", ".join(f"CASE WHEN h{s} >= {s[:-2]} THEN round(TRY_CAST(o{s} / weight / h{s} AS DECIMAL(18, 3)), 4) END AS uo_mlkghr_{s}" for s in _tm)},
  {", ".join(f"round(CAST(h{s} AS DECIMAL(18, 3)), 2) AS uo_tm_{s}" for s in _tm)} FROM r LEFT JOIN weight_durations w ON w.stay_id = r.stay_id AND r.charttime > starttime AND r.charttime <= endtime AND weight > 0""",
)
twin(
    "kdigo_uo", "urine_output weight_durations icustays",
    f"""WITH u AS (SELECT u.stay_id, charttime, urineoutput, CAST(round((epoch_us(charttime) - epoch_us(intime)) / 1e6) AS BIGINT) AS sec, coalesce((epoch_us(charttime) - epoch_us(lag(charttime) OVER (PARTITION BY u.stay_id ORDER BY charttime))) / 3.6e9, 1) AS h
  FROM urine_output u JOIN icustays s ON s.stay_id = u.stay_id),
r AS (SELECT a.stay_id, a.charttime, {", ".join(f"sum(b.urineoutput) FILTER (WHERE a.sec - b.sec <= {n * 3600}) AS o{n}, sum(b.h) FILTER (WHERE a.sec - b.sec <= {n * 3600}) AS h{n}" for n in (6, 12, 24))}
  FROM u a JOIN u b ON a.stay_id = b.stay_id AND a.sec - b.sec BETWEEN 0 AND 86400 GROUP BY 1, 2)
SELECT r.stay_id, r.charttime, weight, {", ".join(f"o{n} AS urineoutput_{n}hr" for n in (6, 12, 24))}, {", ".join(f"CASE WHEN h{n} >= {n}{' AND h6 < 12' if n == 6 else ''} THEN round(TRY_CAST(o{n} / weight / h{n} AS DECIMAL(18, 3)), 4) END AS uo_rt_{n}hr" for n in (6, 12, 24))},
  {", ".join(f"h{n} AS uo_tm_{n}hr" for n in (6, 12, 24))} FROM r LEFT JOIN weight_durations w ON w.stay_id = r.stay_id AND r.charttime >= starttime AND r.charttime < endtime""",
)
_states = ", ".join(f"max(CASE {' '.join(f'''WHEN value = '{x}' THEN {n}''' for x, n in v.items())} END) FILTER (WHERE itemid = 224146) AS {name}" for name, v in bedside.STATES.items())
twin(
    "crrt", "chartevents",
    f"""SELECT stay_id, charttime, {", ".join(_top((c,), n, value="value") for n, c in bedside.CRRT_TEXTS.items())}, {", ".join(_top((c,), n) for n, c in bedside.CRRT_NUMBERS.items())}, {_states}
FROM chartevents WHERE value IS NOT NULL AND itemid IN {_in([*bedside.CRRT_TEXTS.values(), *bedside.CRRT_NUMBERS.values(), 224146])} GROUP BY 1, 2""",
)
_dialysis = _in([*bedside.DIALYSIS_ACCESS, *bedside.DIALYSIS_ACTIVE, *bedside.DIALYSIS_NUMBERS, *bedside.DIALYSIS_TEXTS])
twin(
    "rrt", "chartevents inputevents procedureevents",
    f"""WITH r AS (SELECT DISTINCT stay_id, starttime, endtime, 1 AS act, 'CRRT' AS kind FROM inputevents WHERE amount > 0 AND itemid IN {_in(bedside.DIALYSIS_INPUTS)}
  UNION SELECT stay_id, starttime, endtime, CASE WHEN itemid IN {_in(bedside.IDLE_PROCEDURES)} THEN 0 ELSE 1 END, CASE itemid {" ".join(f"WHEN {c} THEN '{n}'" for c, n in bedside.DIALYSIS_PROCEDURES.items() if n)} END
  FROM procedureevents WHERE value IS NOT NULL AND itemid IN {_in(bedside.DIALYSIS_PROCEDURES)}),
p AS (SELECT stay_id, charttime, CASE WHEN itemid IN {_in(bedside.DIALYSIS_ACTIVE)} OR (itemid = 225965 AND value = 'In use') THEN 1 ELSE 0 END AS act,
  CASE WHEN itemid = 227290 THEN value WHEN itemid IN {_in(bedside.PERITONEAL)} THEN 'Peritoneal' WHEN itemid = 226499 THEN 'IHD' END AS kind FROM chartevents WHERE value IS NOT NULL AND itemid IN {_dialysis}
  UNION SELECT stay_id, starttime, act, kind FROM r)
SELECT p.stay_id, charttime, 1 AS dialysis_present, coalesce(r.act, p.act) AS dialysis_active, coalesce(r.kind, p.kind) AS dialysis_type FROM p LEFT JOIN r ON r.stay_id = p.stay_id AND charttime BETWEEN r.starttime AND r.endtime""",
)
_named = [f"CASE {column} {' '.join(f'''WHEN '{a}' THEN '{b}' ''' for a, b in names.items())} ELSE {column} END AS {out}" for column, names, out in (("label", bedside.LINE_TYPES, "line_type"), ("location", bedside.LINE_SITES, "line_site"))]
twin("invasive_line", "procedureevents d_items", f"SELECT stay_id, {', '.join(_named)}, starttime, endtime FROM procedureevents p JOIN d_items d ON d.itemid = p.itemid WHERE p.itemid IN {_in(bedside.LINES)}")


# ---- first day ----
def _day(table: str, key: str, columns: str, before: str = "6 HOUR", where: str = "true") -> str:
    return f"""SELECT s.subject_id, s.stay_id, {columns} FROM icustays s LEFT JOIN {table} x ON x.{key} = s.{key} AND charttime >= intime - INTERVAL {before} AND charttime <= intime + INTERVAL 1 DAY AND {where} GROUP BY 1, 2"""


def _ends(names: dict[str, str]) -> str:
    return ", ".join(f"{f}(x.{c}) AS {n}_{f}" for c, n in names.items() for f in ("min", "max"))


_vital_names = ("heart_rate", "sbp", "dbp", "mbp", "resp_rate", "temperature", "spo2", "glucose")
twin("first_day_vitalsign", "icustays vitalsign", _day("vitalsign", "stay_id", ", ".join(f"min(x.{v}) AS {v}_min, max(x.{v}) AS {v}_max, avg(x.{v}) AS {v}_mean" for v in _vital_names)))
twin("first_day_urine_output", "icustays urine_output", _day("urine_output", "stay_id", "sum(urineoutput) AS urineoutput", "0 HOUR"))
twin("first_day_height", "icustays height", _day("height", "stay_id", "round(CAST(avg(height) AS DECIMAL(18, 3)), 2) AS height"))
twin("first_day_bg", "bg icustays", _day("bg", "subject_id", _ends({x: x for x in firstday.GASES})))
twin("first_day_bg_art", "bg icustays", _day("bg", "subject_id", _ends({x: x for x in firstday.GASES}), where="specimen = 'ART.'"))
twin(
    "first_day_gcs", "gcs icustays",
    """WITH r AS (SELECT g.*, row_number() OVER (PARTITION BY g.stay_id ORDER BY gcs NULLS FIRST, charttime) AS n FROM gcs g JOIN icustays s ON s.stay_id = g.stay_id WHERE charttime BETWEEN intime - INTERVAL 6 HOUR AND intime + INTERVAL 1 DAY)
SELECT s.subject_id, s.stay_id, gcs AS gcs_min, gcs_motor, gcs_verbal, gcs_eyes, gcs_unable FROM icustays s LEFT JOIN r ON r.stay_id = s.stay_id AND n = 1""",
)
twin(
    "first_day_lab", " ".join(firstday.LABS) + " icustays",
    "SELECT * FROM " + " NATURAL JOIN ".join(f"({_day(t, 'subject_id', _ends(names))})" for t, names in firstday.LABS.items()),
)
twin("first_day_rrt", "rrt icustays", _day("rrt", "stay_id", "max(dialysis_present) AS dialysis_present, max(dialysis_active) AS dialysis_active, string_agg(DISTINCT dialysis_type, ', ' ORDER BY dialysis_type) AS dialysis_type"))
twin(
    "first_day_weight", "weight_durations icustays",
    """SELECT s.subject_id, s.stay_id, avg(weight) FILTER (WHERE weight_type = 'admit') AS weight_admit, avg(weight) AS weight, min(weight) AS weight_min, max(weight) AS weight_max
FROM icustays s LEFT JOIN weight_durations w ON w.stay_id = s.stay_id AND starttime <= intime + INTERVAL 1 DAY GROUP BY 1, 2""",
)

# ---- scores ----
_organs = ["respiration", *scores.ORGANS]


def _sum(names) -> str:
    return " + ".join(f"coalesce({n}, 0)" for n in names)


def _pieces(rules: dict) -> str:
    return ", ".join(f"{scores.case(r)} AS {n}" for n, r in rules.items())


twin(
    "first_day_sofa", "icustays bg ventilation first_day_vitalsign first_day_lab first_day_urine_output first_day_gcs norepinephrine epinephrine dopamine dobutamine",
    f"""WITH {", ".join(f"r_{a} AS (SELECT s.stay_id, max(vaso_rate) AS rate_{a} FROM icustays s JOIN {a} x ON x.stay_id = s.stay_id AND starttime BETWEEN intime - INTERVAL 6 HOUR AND intime + INTERVAL 1 DAY GROUP BY 1)" for a in scores.PRESSORS)},
p AS (SELECT s.stay_id, min(pao2fio2ratio) FILTER (WHERE v.stay_id IS NULL) AS novent, min(pao2fio2ratio) FILTER (WHERE v.stay_id IS NOT NULL) AS vent FROM icustays s
  JOIN bg ON bg.subject_id = s.subject_id AND charttime BETWEEN intime - INTERVAL 6 HOUR AND intime + INTERVAL 1 DAY LEFT JOIN ventilation v ON v.stay_id = s.stay_id AND charttime BETWEEN starttime AND endtime AND ventilation_status = 'InvasiveVent' GROUP BY 1),
c AS (SELECT s.subject_id, s.hadm_id, s.stay_id, {", ".join(f"rate_{a}" for a in scores.PRESSORS)}, novent, vent, mbp_min, creatinine_max, bilirubin_total_max AS bilirubin_max, platelets_min AS platelet_min, urineoutput AS urine, gcs_min FROM icustays s
  {" ".join(f"LEFT JOIN r_{a} ON r_{a}.stay_id = s.stay_id" for a in scores.PRESSORS)} LEFT JOIN p ON p.stay_id = s.stay_id LEFT JOIN first_day_vitalsign v ON v.stay_id = s.stay_id LEFT JOIN first_day_lab l ON l.stay_id = s.stay_id
  LEFT JOIN first_day_urine_output u ON u.stay_id = s.stay_id LEFT JOIN first_day_gcs g ON g.stay_id = s.stay_id),
o AS (SELECT subject_id, hadm_id, stay_id, {_pieces({"respiration": scores.BREATH_DAY, **scores.ORGANS})} FROM c)
SELECT subject_id, hadm_id, stay_id, {_sum(_organs)} AS sofa, {", ".join(_organs)} FROM o""",
)


def _hourly(name: str, table: str, key: str, columns: str) -> str:
    return f"{name} AS (SELECT h.stay_id, h.hr, {columns} FROM h JOIN {table} x ON x.{key} = h.{key} AND x.charttime > h.starttime AND x.charttime <= h.endtime GROUP BY 1, 2)"


_given = ", ".join(f"q_{a} AS (SELECT h.stay_id, h.hr, max(vaso_rate) AS rate_{a} FROM h JOIN {a} x ON x.stay_id = h.stay_id AND h.endtime > x.starttime AND h.endtime <= x.endtime GROUP BY 1, 2)" for a in scores.PRESSORS)
_hour_tables = ["pf", "vs", "gc", "bi", "cr", "pl", "ur", *[f"q_{a}" for a in scores.PRESSORS]]
twin(
    "sofa", "icustays icustay_hourly bg ventilation vitalsign gcs enzyme chemistry complete_blood_count urine_output_rate norepinephrine epinephrine dopamine dobutamine",
    f"""WITH h AS (SELECT i.stay_id, s.hadm_id, i.hr, i.endtime - INTERVAL 1 HOUR AS starttime, i.endtime FROM icustay_hourly i JOIN icustays s ON s.stay_id = i.stay_id),
a AS (SELECT s.stay_id, charttime, pao2fio2ratio, EXISTS (SELECT 1 FROM ventilation v WHERE v.stay_id = s.stay_id AND charttime BETWEEN starttime AND endtime AND ventilation_status = 'InvasiveVent') AS held
  FROM icustays s JOIN bg ON bg.subject_id = s.subject_id WHERE specimen = 'ART.'),
{_hourly("pf", "a", "stay_id", "min(pao2fio2ratio) FILTER (WHERE NOT held) AS novent, min(pao2fio2ratio) FILTER (WHERE held) AS vent")}, {_hourly("vs", "vitalsign", "stay_id", "min(mbp) AS mbp_min")}, {_hourly("gc", "gcs", "stay_id", "min(gcs) AS gcs_min")},
{_hourly("bi", "enzyme", "hadm_id", "max(bilirubin_total) AS bilirubin_max")}, {_hourly("cr", "chemistry", "hadm_id", "max(creatinine) AS creatinine_max")}, {_hourly("pl", "complete_blood_count", "hadm_id", "min(platelet) AS platelet_min")},
{_hourly("ur", "urine_output_rate", "stay_id", "max(CASE WHEN uo_tm_24hr BETWEEN 22 AND 30 THEN urineoutput_24hr / CAST(uo_tm_24hr AS DOUBLE) * 24 END) AS urine")}, {_given},
c AS (SELECT * FROM h {" ".join(f"LEFT JOIN {t} USING (stay_id, hr)" for t in _hour_tables)}),
o AS (SELECT *, {_pieces({"respiration": scores.BREATH_HOUR, **scores.ORGANS})} FROM c),
w AS (SELECT *, {", ".join(f"coalesce(max({n}) OVER w, 0) AS {n}_24hours" for n in _organs)} FROM o WINDOW w AS (PARTITION BY stay_id ORDER BY hr ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT stay_id, hr, starttime, endtime, novent AS pao2fio2ratio_novent, vent AS pao2fio2ratio_vent, rate_epinephrine, rate_norepinephrine, rate_dopamine, rate_dobutamine, mbp_min AS meanbp_min, gcs_min, urine AS uo_24hr, bilirubin_max, creatinine_max,
  platelet_min, {", ".join(_organs)}, {", ".join(f"{n}_24hours" for n in _organs)}, {" + ".join(f"{n}_24hours" for n in _organs)} AS sofa_24hours FROM w WHERE hr >= 0""",
)
twin(
    "sirs", "icustays first_day_bg_art first_day_vitalsign first_day_lab",
    f"""WITH c AS (SELECT s.subject_id, s.hadm_id, s.stay_id, v.*, l.*, b.pco2_min AS paco2_min FROM icustays s LEFT JOIN first_day_bg_art b ON b.stay_id = s.stay_id LEFT JOIN (SELECT stay_id AS vs, temperature_min, temperature_max, heart_rate_max, resp_rate_max FROM first_day_vitalsign) v ON vs = s.stay_id
  LEFT JOIN (SELECT stay_id AS ls, wbc_min, wbc_max, bands_max FROM first_day_lab) l ON ls = s.stay_id), p AS (SELECT subject_id, hadm_id, stay_id, {_pieces(scores.SIRS)} FROM c)
SELECT subject_id, hadm_id, stay_id, {_sum(scores.SIRS)} AS sirs, {", ".join(scores.SIRS)} FROM p""",
)
twin(
    "meld", "icustays first_day_lab first_day_rrt",
    """WITH c AS (SELECT s.subject_id, s.hadm_id, s.stay_id, dialysis_present AS rrt, creatinine_max, bilirubin_total_max, inr_max, sodium_min FROM icustays s LEFT JOIN first_day_lab l ON l.stay_id = s.stay_id LEFT JOIN first_day_rrt r ON r.stay_id = s.stay_id),
t AS (SELECT *, 0.957 * ln(CASE WHEN rrt = 1 OR creatinine_max > 4 THEN 4 ELSE greatest(coalesce(creatinine_max, 1), 1) END) + 0.378 * ln(greatest(coalesce(bilirubin_total_max, 1), 1)) + (1.120 * ln(greatest(coalesce(inr_max, 1), 1)) + 0.643) AS raw,
  CASE WHEN sodium_min > 137 OR sodium_min IS NULL THEN 0 ELSE 137 - greatest(sodium_min, 125) END AS sodium_score FROM c),
m AS (SELECT *, CASE WHEN raw > 4 THEN 40.0 ELSE CAST(round(CAST(raw AS DECIMAL(18, 3)), 1) AS DOUBLE) * 10 END AS meld_initial FROM t)
SELECT subject_id, hadm_id, stay_id, meld_initial, CASE WHEN meld_initial > 11 THEN meld_initial + 1.32 * sodium_score - 0.033 * meld_initial * sodium_score ELSE meld_initial END AS meld, rrt, creatinine_max, bilirubin_total_max, inr_max, sodium_min FROM m""",
)
twin(
    "kdigo_stages", "icustays kdigo_creatinine kdigo_uo crrt",
    f"""WITH c AS (SELECT stay_id, charttime, creat_low_past_7day, creat_low_past_48hr, creat, {scores.case(scores.CREATININE_STAGE)} AS aki_stage_creat FROM kdigo_creatinine),
e AS (SELECT u.*, charttime <= intime + INTERVAL 6 HOUR AS early FROM kdigo_uo u JOIN icustays s ON s.stay_id = u.stay_id), u AS (SELECT stay_id, charttime, uo_rt_6hr, uo_rt_12hr, uo_rt_24hr, {scores.case(scores.URINE_STAGE)} AS aki_stage_uo FROM e),
d AS (SELECT stay_id, charttime, CASE WHEN charttime IS NOT NULL THEN 3 END AS aki_stage_crrt FROM crrt WHERE crrt_mode IS NOT NULL), k AS (SELECT stay_id, charttime FROM c UNION SELECT stay_id, charttime FROM u UNION SELECT stay_id, charttime FROM d),
j AS (SELECT s.subject_id, s.hadm_id, s.stay_id, k.charttime, epoch_us(k.charttime) - epoch_us(intime) AS since, c.* EXCLUDE (stay_id, charttime), u.* EXCLUDE (stay_id, charttime), aki_stage_crrt,
  greatest(coalesce(aki_stage_creat, 0), coalesce(aki_stage_uo, 0), coalesce(aki_stage_crrt, 0)) AS aki_stage
  FROM icustays s LEFT JOIN k ON k.stay_id = s.stay_id LEFT JOIN c ON c.stay_id = s.stay_id AND c.charttime = k.charttime LEFT JOIN u ON u.stay_id = s.stay_id AND u.charttime = k.charttime LEFT JOIN d ON d.stay_id = s.stay_id AND d.charttime = k.charttime)
SELECT subject_id, hadm_id, stay_id, charttime, creat_low_past_7day, creat_low_past_48hr, creat, aki_stage_creat, uo_rt_6hr, uo_rt_12hr, uo_rt_24hr, aki_stage_uo, aki_stage_crrt, aki_stage,
  CASE WHEN since IS NULL THEN max(aki_stage) OVER (PARTITION BY subject_id, since IS NULL) ELSE max(aki_stage) OVER (PARTITION BY subject_id ORDER BY since RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) END AS aki_stage_smoothed FROM j""",
)
twin(
    "oasis", "icustays admissions age services ventilation first_day_gcs first_day_vitalsign first_day_urine_output",
    f"""WITH c AS (SELECT s.subject_id, s.hadm_id, s.stay_id, age, (epoch_us(intime) - epoch_us(a.admittime)) / 6e7 AS preiculos, gcs_min, v.* EXCLUDE (subject_id, stay_id), urineoutput,
  CASE WHEN EXISTS (SELECT 1 FROM ventilation x WHERE x.stay_id = s.stay_id AND ventilation_status = 'InvasiveVent' AND (x.starttime BETWEEN intime AND intime + INTERVAL 1 DAY OR x.endtime BETWEEN intime AND intime + INTERVAL 1 DAY
    OR (x.starttime <= intime AND x.endtime >= intime + INTERVAL 1 DAY))) THEN 1 ELSE 0 END AS mechvent,
  CASE WHEN admission_type IS NULL THEN NULL WHEN admission_type = 'ELECTIVE' AND EXISTS (SELECT 1 FROM services w WHERE w.hadm_id = s.hadm_id AND transfertime < intime + INTERVAL 1 DAY AND (lower(curr_service) LIKE '%surg%' OR curr_service = 'ORTHO')) THEN 1 ELSE 0 END AS electivesurgery
  FROM icustays s JOIN admissions a ON a.hadm_id = s.hadm_id LEFT JOIN age ON age.hadm_id = s.hadm_id LEFT JOIN first_day_gcs g ON g.stay_id = s.stay_id LEFT JOIN first_day_vitalsign v ON v.stay_id = s.stay_id LEFT JOIN first_day_urine_output u ON u.stay_id = s.stay_id),
p AS (SELECT *, {_pieces(scores.OASIS)}, {", ".join(f"{scores._worst(*w)} AS {n}" for n, w in scores.OASIS_WORST.items())} FROM c), t AS (SELECT *, {_sum(scores.OASIS)} AS oasis FROM p)
SELECT subject_id, hadm_id, stay_id, oasis, 1 / (1 + exp(6.1746 - 0.1275 * oasis)) AS oasis_prob, age, preiculos, gcs_min AS gcs, {", ".join(scores.OASIS_WORST)}, urineoutput, mechvent, electivesurgery, {", ".join(scores.OASIS)} FROM t""",
)

# ---- infection, comorbidity, stays ----
_likes = " OR ".join(f"drug ILIKE '%{t}%'" for t in infection.ANTIBIOTICS)
twin(
    "antibiotic", "prescriptions icustays",
    f"""WITH listed AS (SELECT DISTINCT drug, route FROM prescriptions WHERE drug_type <> 'BASE' AND route NOT IN {_in(infection.LOCAL_ROUTES)} AND route NOT ILIKE '%ear%' AND route NOT ILIKE '%eye%' AND {" AND ".join(f"drug NOT ILIKE '%{x}%'" for x in infection.LOCAL_FORMS)} AND ({_likes}))
SELECT p.subject_id, p.hadm_id, stay_id, p.drug AS antibiotic, p.route, starttime, stoptime FROM prescriptions p JOIN listed ON listed.drug = p.drug AND listed.route = p.route
  LEFT JOIN icustays s ON s.hadm_id = p.hadm_id AND starttime >= intime AND starttime < outtime""",
)
_cultures = "SELECT ab_id, a.subject_id, row_number() OVER (PARTITION BY a.subject_id, ab_id ORDER BY chartdate NULLS FIRST, charttime NULLS LAST, micro_specimen_id) AS n, coalesce(charttime, CAST(chartdate AS TIMESTAMP)) AS at, spec, pos FROM a JOIN m ON m.patient = a.subject_id"
twin(
    "suspicion_of_infection", "antibiotic microbiologyevents",
    f"""WITH a AS (SELECT *, starttime AS t, CAST(starttime AS DATE) AS d, row_number() OVER (PARTITION BY subject_id ORDER BY starttime NULLS FIRST, stoptime NULLS FIRST, antibiotic NULLS FIRST, route NULLS FIRST, hadm_id NULLS FIRST, stay_id NULLS FIRST) AS ab_id FROM antibiotic),
m AS (SELECT micro_specimen_id, max(subject_id) AS patient, max(chartdate) AS chartdate, max(charttime) AS charttime, max(spec_type_desc) AS spec, max(CASE WHEN org_itemid <> 90856 AND org_name <> '' THEN 1 ELSE 0 END) AS pos FROM microbiologyevents GROUP BY 1),
b AS ({_cultures} AND ((charttime IS NOT NULL AND t > charttime AND t <= charttime + INTERVAL 72 HOUR) OR (charttime IS NULL AND d BETWEEN chartdate AND chartdate + INTERVAL 3 DAY))),
f AS ({_cultures} AND ((charttime IS NOT NULL AND t >= charttime - INTERVAL 24 HOUR AND t < charttime) OR (charttime IS NULL AND d BETWEEN chartdate - INTERVAL 1 DAY AND chartdate)))
SELECT a.subject_id, a.stay_id, a.hadm_id, a.ab_id, a.antibiotic, t AS antibiotic_time, CASE WHEN coalesce(b.spec, f.spec) IS NULL THEN 0 ELSE 1 END AS suspected_infection, CASE WHEN coalesce(b.spec, f.spec) IS NOT NULL THEN coalesce(b.at, t) END AS suspected_infection_time,
  coalesce(b.at, f.at) AS culture_time, coalesce(b.spec, f.spec) AS specimen, coalesce(b.pos, f.pos) AS positive_culture
FROM a LEFT JOIN b ON b.subject_id = a.subject_id AND b.ab_id = a.ab_id AND b.n = 1 LEFT JOIN f ON f.subject_id = a.subject_id AND f.ab_id = a.ab_id AND f.n = 1""",
)
_plain = [o for o in _organs]
twin(
    "sepsis3", "sofa suspicion_of_infection",
    f"""WITH j AS (SELECT i.subject_id, i.stay_id, antibiotic_time, culture_time, suspected_infection_time, endtime AS sofa_time, sofa_24hours AS sofa_score, {", ".join(f"{o}_24hours AS {o}" for o in _plain)}, suspected_infection = 1 AS sepsis3,
  row_number() OVER (PARTITION BY i.stay_id ORDER BY suspected_infection_time, antibiotic_time, culture_time NULLS FIRST, endtime, ab_id) AS n FROM suspicion_of_infection i JOIN sofa s ON s.stay_id = i.stay_id AND sofa_24hours >= 2
  AND endtime BETWEEN suspected_infection_time - INTERVAL 48 HOUR AND suspected_infection_time + INTERVAL 24 HOUR) SELECT * EXCLUDE (n) FROM j WHERE n = 1""",
)


def _group(prefixes, version: int) -> str:
    tests = [f"starts_with(icd_code, '{p}')" if isinstance(p, str) else f"left(icd_code, {len(p[0])}) BETWEEN '{p[0]}' AND '{p[1]}'" for p in prefixes]
    return f"(icd_version = {version} AND ({' OR '.join(tests)}))"


_flags = ", ".join(f"CASE WHEN bool_or({_group(nine, 9)} OR {_group(ten, 10)}) THEN 1 ELSE 0 END AS {n}" for n, (nine, ten) in comorbidity.CHARLSON.items())
twin(
    "charlson", "admissions diagnoses_icd age",
    f"""WITH f AS (SELECT a.subject_id, a.hadm_id, {_flags} FROM admissions a LEFT JOIN diagnoses_icd d ON d.hadm_id = a.hadm_id GROUP BY 1, 2),
g AS (SELECT f.*, CASE WHEN age <= 50 THEN 0 WHEN age <= 60 THEN 1 WHEN age <= 70 THEN 2 WHEN age <= 80 THEN 3 ELSE 4 END AS age_score FROM f LEFT JOIN age ON age.hadm_id = f.hadm_id)
SELECT subject_id, hadm_id, age_score, {", ".join(comorbidity.CHARLSON)}, age_score + {" + ".join(n for n in comorbidity.CHARLSON if n not in comorbidity.GRADED)} + CASE WHEN severe_liver_disease = 1 THEN 3 ELSE mild_liver_disease END
  + CASE WHEN diabetes_with_cc = 1 THEN 2 ELSE diabetes_without_cc END + CASE WHEN metastatic_solid_tumor = 1 THEN 6 ELSE 2 * malignant_cancer END + 2 * (paraplegia + renal_disease) + 6 * aids AS charlson_comorbidity_index FROM g""",
)
twin(
    "creatinine_baseline", "age chemistry diagnoses_icd patients",
    """WITH e AS (SELECT hadm_id, gender, age, power(75.0 / 186.0 / power(age, -0.203) / CASE WHEN gender = 'F' THEN 0.742 ELSE 1 END, -1 / 1.154) AS mdrd_est, (SELECT min(creatinine) FROM chemistry c WHERE c.hadm_id = g.hadm_id) AS scr_min,
  CASE WHEN EXISTS (SELECT 1 FROM diagnoses_icd d WHERE d.hadm_id = g.hadm_id AND ((icd_version = 9 AND icd_code LIKE '585%') OR (icd_version = 10 AND icd_code LIKE 'N18%'))) THEN 1 ELSE 0 END AS ckd
  FROM age g LEFT JOIN patients p ON p.subject_id = g.subject_id WHERE age >= 18) SELECT *, CASE WHEN scr_min <= 1.1 OR ckd = 1 THEN scr_min ELSE mdrd_est END AS scr_baseline FROM e""",
)
twin(
    "icustay_detail", "icustays admissions patients",
    """SELECT s.subject_id, s.hadm_id, s.stay_id, gender, dod, admittime, dischtime, (epoch_us(dischtime) - epoch_us(admittime)) / 8.64e10 AS los_hospital, anchor_age + (epoch_us(admittime) - epoch_us(make_timestamp(anchor_year, 1, 1, 0, 0, 0))) / 31556908800000.0 AS admission_age,
  race, hospital_expire_flag, dense_rank() OVER h AS hospstay_seq, dense_rank() OVER h = 1 AS first_hosp_stay, intime AS icu_intime, outtime AS icu_outtime, round(CAST((epoch_us(outtime) - epoch_us(intime)) / 8.64e10 AS DECIMAL(18, 3)), 2) AS los_icu,
  dense_rank() OVER i AS icustay_seq, dense_rank() OVER i = 1 AS first_icu_stay FROM icustays s JOIN admissions a ON a.hadm_id = s.hadm_id JOIN patients p ON p.subject_id = s.subject_id
WINDOW h AS (PARTITION BY a.subject_id ORDER BY admittime), i AS (PARTITION BY s.hadm_id ORDER BY intime)""",
)


# ---- severity ----
def _codes(groups: dict) -> str:
    return ", ".join(f"CASE WHEN bool_or({_group(nine, 9)} OR {_group(ten, 10)}) THEN 1 ELSE 0 END AS {n}" for n, (nine, ten) in groups.items())


_vent_at = "EXISTS (SELECT 1 FROM ventilation v WHERE v.stay_id = s.stay_id AND ventilation_status = 'InvasiveVent' AND b.charttime {op} v.starttime AND b.charttime <= v.endtime)"
_mask_at = "EXISTS (SELECT 1 FROM m WHERE m.{key} = s.{key} AND b.charttime {op} m.low AND b.charttime <= m.high)"
twin(
    "lods", "icustays chartevents bg ventilation first_day_gcs first_day_vitalsign first_day_lab first_day_urine_output",
    f"""WITH m AS (SELECT s.stay_id, min(charttime) - INTERVAL 1 HOUR AS low, max(charttime) + INTERVAL 4 HOUR AS high FROM icustays s JOIN chartevents c ON c.stay_id = s.stay_id AND charttime BETWEEN intime AND intime + INTERVAL 1 DAY
  WHERE itemid = 226732 AND (value ILIKE '%cpap%' OR value ILIKE '%bipap mask%') GROUP BY 1),
p AS (SELECT s.stay_id, min(pao2fio2ratio) AS pao2fio2_vent_min FROM icustays s JOIN bg b ON b.hadm_id = s.hadm_id AND charttime >= intime AND charttime < outtime
  WHERE {_vent_at.format(op=">=")} OR {_mask_at.format(key="stay_id", op=">=")} GROUP BY 1),
c AS (SELECT s.subject_id, s.hadm_id, s.stay_id, p.*, g.gcs_min, v.* EXCLUDE (subject_id, stay_id), l.* EXCLUDE (subject_id, stay_id, glucose_min, glucose_max), urineoutput FROM icustays s LEFT JOIN (SELECT stay_id AS ps, pao2fio2_vent_min FROM p) p ON ps = s.stay_id LEFT JOIN first_day_gcs g ON g.stay_id = s.stay_id
  LEFT JOIN first_day_vitalsign v ON v.stay_id = s.stay_id LEFT JOIN first_day_lab l ON l.stay_id = s.stay_id LEFT JOIN first_day_urine_output u ON u.stay_id = s.stay_id),
o AS (SELECT subject_id, hadm_id, stay_id, {_pieces(severity.LODS)} FROM c)
SELECT subject_id, hadm_id, stay_id, {_sum(severity.LODS)} AS lods, {", ".join(severity.LODS)} FROM o""",
)


def _first_24(name: str, table: str, key: str, columns: str) -> str:
    return f"{name} AS (SELECT s.stay_id AS {name}_stay, {columns} FROM icustays s LEFT JOIN {table} x ON x.{key} = s.{key} AND x.charttime > intime AND x.charttime <= intime + INTERVAL 1 DAY GROUP BY 1)"


def _both(*names: str) -> str:
    return ", ".join(f"min({n}) AS {n}_min, max({n}) AS {n}_max" for n in names)


_joined = {
    "n1": ("vitalsign", "subject_id", _both("heart_rate", "sbp", "temperature")), "n2": ("chemistry", "subject_id", _both("bun", "potassium", "sodium", "bicarbonate")),
    "n3": ("complete_blood_count", "subject_id", _both("wbc")), "n4": ("enzyme", "subject_id", _both("bilirubin_total")), "n5": ("gcs", "stay_id", "min(gcs) AS gcs_min"),
    "n6": ("urine_output", "stay_id", "sum(urineoutput) AS urineoutput"),
}
twin(
    "sapsii", "icustays admissions age services diagnoses_icd chartevents bg ventilation gcs vitalsign urine_output chemistry complete_blood_count enzyme",
    f"""WITH m AS (SELECT s.subject_id, s.stay_id, greatest(min(charttime) - INTERVAL 1 HOUR, min(intime)) AS low, least(max(charttime) + INTERVAL 4 HOUR, min(intime) + INTERVAL 1 DAY) AS high FROM icustays s
  JOIN chartevents c ON c.stay_id = s.stay_id AND charttime > intime AND charttime <= intime + INTERVAL 1 DAY WHERE itemid = 226732 AND (value ILIKE '%cpap mask%' OR value ILIKE '%bipap%') GROUP BY 1, 2),
p AS (SELECT s.stay_id AS ps, min(pao2fio2ratio) AS pao2fio2_vent_min FROM icustays s JOIN bg b ON b.subject_id = s.subject_id AND charttime > intime AND charttime <= intime + INTERVAL 1 DAY AND specimen = 'ART.'
  WHERE {_vent_at.format(op=">")} OR {_mask_at.format(key="subject_id", op=">")} GROUP BY 1),
d AS (SELECT hadm_id, {_codes(severity.SAPS_GROUPS)} FROM diagnoses_icd GROUP BY 1), w AS (SELECT hadm_id, CASE WHEN curr_service ILIKE '%surg%' THEN 1 ELSE 0 END AS surgical, row_number() OVER (PARTITION BY hadm_id ORDER BY transfertime NULLS FIRST, curr_service) AS n FROM services),
{", ".join(_first_24(n, *x) for n, x in _joined.items())},
c AS (SELECT s.subject_id, s.hadm_id, s.stay_id, intime, admission_type, surgical, age, aids, hem, mets, pao2fio2_vent_min, {", ".join(f"{n}.* EXCLUDE ({n}_stay)" for n in _joined)}
  FROM icustays s JOIN admissions a ON a.hadm_id = s.hadm_id LEFT JOIN age ON age.hadm_id = s.hadm_id LEFT JOIN w ON w.hadm_id = s.hadm_id AND n = 1 LEFT JOIN d ON d.hadm_id = s.hadm_id LEFT JOIN p ON ps = s.stay_id
  {" ".join(f"JOIN {n} ON {n}_stay = s.stay_id" for n in _joined)}),
o AS (SELECT *, {_pieces(severity.SAPS)} FROM c), t AS (SELECT *, {_sum(severity.SAPS)} AS sapsii FROM o)
SELECT subject_id, hadm_id, stay_id, intime AS starttime, intime + INTERVAL 1 DAY AS endtime, sapsii, 1 / (1 + exp(7.7631 - 0.0737 * sapsii - 0.9971 * ln(sapsii + 1))) AS sapsii_prob, {", ".join(severity.SAPS)} FROM t""",
)


def _far(score: str) -> str:
    value, middle, _, _ = severity.APS[score]
    low, high = severity.bands(score, f"{value}_min"), severity.bands(score, f"{value}_max")
    if middle is None:
        return f"{high} AS {score}"
    arf = f"WHEN arf = 1 THEN {high} " if score == "creatinine_score" else ""
    return f"CASE {arf}WHEN abs({value}_max - {middle}) > abs({value}_min - {middle}) THEN {high} WHEN abs({value}_max - {middle}) < abs({value}_min - {middle}) THEN {low} WHEN {value}_max IS NOT NULL THEN greatest({low}, {high}) END AS {score}"


_gas = "SELECT s.stay_id AS {name}_stay, max({what}) AS {name} FROM icustays s JOIN bg b ON b.hadm_id = s.hadm_id AND charttime >= intime AND charttime < outtime AND specimen = 'ART.' WHERE {where} GROUP BY 1"
_other = "stay_id, subject_id"
twin(
    "apsiii", "icustays diagnoses_icd bg ventilation first_day_gcs first_day_vitalsign first_day_urine_output first_day_lab",
    f"""WITH pao AS ({_gas.format(name="pao2", what="po2", where=f"NOT {_vent_at.format(op='>=')} AND coalesce(fio2, fio2_chartevents, 21) < 50")}), aad AS ({_gas.format(name="aado2", what="b.aado2", where=f"{_vent_at.format(op='>=')} AND coalesce(fio2, fio2_chartevents) >= 50")}),
acid AS ({_gas.format(name="acidbase_score", what=scores.case(severity.APS_ACID), where="ph IS NOT NULL AND pco2 IS NOT NULL")}),
k AS (SELECT hadm_id, {_codes({"ckd": severity.KIDNEY_FAILURE})} FROM diagnoses_icd GROUP BY 1),
c AS (SELECT s.subject_id, s.hadm_id, s.stay_id, pao2, aado2, acidbase_score, v.* EXCLUDE ({_other}, glucose_min, glucose_max), l.* EXCLUDE ({_other}, glucose_min, glucose_max), greatest(v.glucose_max, l.glucose_max) AS glucose_max, least(v.glucose_min, l.glucose_min) AS glucose_min,
  urineoutput, gcs_motor, gcs_verbal, gcs_eyes, gcs_unable, CASE WHEN creatinine_max >= 1.5 AND urineoutput < 410 AND ckd = 0 THEN 1 ELSE 0 END AS arf,
  CASE WHEN EXISTS (SELECT 1 FROM ventilation x WHERE x.stay_id = s.stay_id AND ventilation_status = 'InvasiveVent' AND (x.starttime BETWEEN intime AND intime + INTERVAL 1 DAY OR x.endtime BETWEEN intime AND intime + INTERVAL 1 DAY
    OR (x.starttime <= intime AND x.endtime >= intime + INTERVAL 1 DAY))) THEN 1 ELSE 0 END AS vent
  FROM icustays s LEFT JOIN pao ON pao2_stay = s.stay_id LEFT JOIN aad ON aado2_stay = s.stay_id LEFT JOIN acid ON acidbase_score_stay = s.stay_id LEFT JOIN k ON k.hadm_id = s.hadm_id LEFT JOIN first_day_gcs g ON g.stay_id = s.stay_id
  LEFT JOIN first_day_vitalsign v ON v.stay_id = s.stay_id LEFT JOIN first_day_lab l ON l.stay_id = s.stay_id LEFT JOIN first_day_urine_output u ON u.stay_id = s.stay_id),
o AS (SELECT subject_id, hadm_id, stay_id, acidbase_score, {", ".join(_far(n) for n in severity.APS)}, {scores.case(severity.APS_URINE)} AS uo_score, {scores.case(severity.APS_OXYGEN)} AS pao2_aado2_score, {scores.case(severity.APS_COMA)} AS gcs_score FROM c),
t AS (SELECT *, {_sum(severity.APS_NAMES)} AS apsiii FROM o)
SELECT subject_id, hadm_id, stay_id, apsiii, 1 / (1 + exp(4.4360 - 0.04726 * apsiii)) AS apsiii_prob, {", ".join(severity.APS_NAMES)} FROM t""",
)
_milder = ", ".join(f"CASE WHEN {grave} = 1 THEN 0 ELSE {mild} END AS {mild}" for mild, grave in elixhauser.GRAVER.items())
twin(
    "elixhauser", "admissions diagnoses_icd",
    f"""WITH f AS (SELECT a.subject_id, a.hadm_id, {_codes(elixhauser.GROUPS)} FROM admissions a LEFT JOIN diagnoses_icd d ON d.hadm_id = a.hadm_id AND seq_num <> 1 GROUP BY 1, 2), g AS (SELECT * REPLACE ({_milder}) FROM f)
SELECT *, {" + ".join(elixhauser.GROUPS)} AS elixhauser_count, {" + ".join(f"{w} * {n}" for n, w in elixhauser.WEIGHTS.items())} AS elixhauser_vanwalraven FROM g""",
)

# ---- scores over twelve hours, with their thresholds written out ----
_twelve = "charttime BETWEEN intime - INTERVAL 6 HOUR AND intime + INTERVAL 12 HOUR"
_drip = lambda n: f"(SELECT max(vaso_rate) FROM {n} m WHERE m.stay_id = i.stay_id AND starttime BETWEEN intime - INTERVAL 6 HOUR AND intime + INTERVAL 12 HOUR) AS {n}_rate"
twin(
    "sofa_12h", "icustays bg ventilation vitalsign chemistry enzyme complete_blood_count gcs norepinephrine epinephrine dopamine dobutamine",
    f"""WITH g AS (SELECT i.stay_id, min(CASE WHEN v.stay_id IS NULL THEN pao2fio2ratio END) AS novent, min(CASE WHEN v.stay_id IS NOT NULL THEN pao2fio2ratio END) AS vent FROM icustays i JOIN bg ON bg.subject_id = i.subject_id AND {_twelve}
  LEFT JOIN ventilation v ON v.stay_id = i.stay_id AND bg.charttime >= v.starttime AND bg.charttime <= v.endtime AND v.ventilation_status = 'InvasiveVent' GROUP BY 1),
p AS (SELECT i.subject_id, i.hadm_id, i.stay_id, novent, vent, (SELECT min(mbp) FROM vitalsign s WHERE s.stay_id = i.stay_id AND {_twelve}) AS mbp, (SELECT min(gcs) FROM gcs s WHERE s.stay_id = i.stay_id AND {_twelve}) AS coma,
  (SELECT max(creatinine) FROM chemistry l WHERE l.hadm_id = i.hadm_id AND {_twelve}) AS creatinine, (SELECT max(bilirubin_total) FROM enzyme l WHERE l.hadm_id = i.hadm_id AND {_twelve}) AS bilirubin,
  (SELECT min(platelet) FROM complete_blood_count l WHERE l.hadm_id = i.hadm_id AND {_twelve}) AS platelet, {_drip("norepinephrine")}, {_drip("epinephrine")}, {_drip("dopamine")}, {_drip("dobutamine")} FROM icustays i LEFT JOIN g ON g.stay_id = i.stay_id),
s AS (SELECT subject_id, hadm_id, stay_id, CASE WHEN vent < 100 THEN 4 WHEN vent < 200 THEN 3 WHEN novent < 300 THEN 2 WHEN novent < 400 THEN 1 ELSE 0 END AS respiration,
  CASE WHEN platelet < 20 THEN 4 WHEN platelet < 50 THEN 3 WHEN platelet < 100 THEN 2 WHEN platelet < 150 THEN 1 ELSE 0 END AS coagulation, CASE WHEN bilirubin >= 12 THEN 4 WHEN bilirubin >= 6 THEN 3 WHEN bilirubin >= 2 THEN 2 WHEN bilirubin >= 1.2 THEN 1 ELSE 0 END AS liver,
  CASE WHEN dopamine_rate > 15 OR epinephrine_rate > 0.1 OR norepinephrine_rate > 0.1 THEN 4 WHEN dopamine_rate > 5 OR epinephrine_rate > 0 OR norepinephrine_rate > 0 THEN 3 WHEN dopamine_rate > 0 OR dobutamine_rate > 0 THEN 2 WHEN mbp < 70 THEN 1 ELSE 0 END AS cardiovascular,
  CASE WHEN coma < 6 THEN 4 WHEN coma <= 9 THEN 3 WHEN coma <= 12 THEN 2 WHEN coma <= 14 THEN 1 ELSE 0 END AS cns, CASE WHEN creatinine >= 5 THEN 4 WHEN creatinine >= 3.5 THEN 3 WHEN creatinine >= 2 THEN 2 WHEN creatinine >= 1.2 THEN 1 ELSE 0 END AS renal FROM p)
SELECT subject_id, hadm_id, stay_id, respiration + coagulation + liver + cardiovascular + cns + renal AS sofa, respiration, coagulation, liver, cardiovascular, cns, renal FROM s""",
)
twin(
    "sirs_12h", "icustays vitalsign bg complete_blood_count blood_differential",
    f"""WITH v AS (SELECT i.stay_id, min(temperature) AS cold, max(temperature) AS warm, max(heart_rate) AS beat, max(resp_rate) AS breath FROM icustays i JOIN vitalsign s ON s.stay_id = i.stay_id AND {_twelve} GROUP BY 1),
p AS (SELECT i.subject_id, i.hadm_id, i.stay_id, cold, warm, beat, breath, (SELECT min(pco2) FROM bg WHERE bg.subject_id = i.subject_id AND specimen = 'ART.' AND {_twelve}) AS gas, (SELECT min(wbc) FROM complete_blood_count c WHERE c.subject_id = i.subject_id AND {_twelve}) AS few,
  (SELECT max(wbc) FROM complete_blood_count c WHERE c.subject_id = i.subject_id AND {_twelve}) AS many, (SELECT max(bands) FROM blood_differential d WHERE d.subject_id = i.subject_id AND {_twelve}) AS bands FROM icustays i LEFT JOIN v ON v.stay_id = i.stay_id),
s AS (SELECT subject_id, hadm_id, stay_id, CASE WHEN cold < 36 OR warm > 38 THEN 1 ELSE 0 END AS temp_score, CASE WHEN beat > 90 THEN 1 ELSE 0 END AS heart_rate_score, CASE WHEN breath > 20 OR gas < 32 THEN 1 ELSE 0 END AS resp_score,
  CASE WHEN few < 4 OR many > 12 OR bands > 10 THEN 1 ELSE 0 END AS wbc_score FROM p)
SELECT subject_id, hadm_id, stay_id, temp_score + heart_rate_score + resp_score + wbc_score AS sirs, temp_score, heart_rate_score, resp_score, wbc_score FROM s""",
)
