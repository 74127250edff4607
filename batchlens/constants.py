"""Domain constants.

FIXED VALUES: the numbers, names and word lists below must equal the
behaviour being reproduced (scenario weights, objective directions, limits,
column vocabularies). They are stated plainly and in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
DEFAULT_EMISSION_FACTOR = 0.82
DEFAULT_ENERGY_COST = 0.12
DEFAULT_ANNUAL_BATCHES = 1200
API_ENERGY_COST = 8.0
API_ANNUAL_BATCHES = 365
MAX_NULL_RATE = 0.55
ENERGY_MAX_KWH = 1_000_000.0
TEMP_MIN_C = -50.0
TEMP_MAX_C = 300.0
PARETO_PROXY_CAP = 300
ISCLOSE_ATOL = 1e-8

PRIMARY_OBJECTIVES = [
    "Yield_Percent",
    "Quality_Score",
    "Performance_Score",
    "Total_Energy_kWh",
    "Carbon_kg",
    "Eco_Efficiency_Score",
]

OBJECTIVE_DIRECTIONS = {
    "Yield_Percent": "max",
    "Quality_Score": "max",
    "Performance_Score": "max",
    "Total_Energy_kWh": "min",
    "Carbon_kg": "min",
    "Eco_Efficiency_Score": "max",
}

CONTROL_PARAMETERS = [
    "Cycle_Time",
    "Process_Agent_Amount",
    "Heat_Temp",
    "Heat_Duration",
    "Press_Force",
    "Machine_Speed",
    "Lubricant_Additive",
    "Moisture_Level",
]

DEFAULT_SCENARIOS = {
    "Balanced": {
        "Yield_Percent": 0.22, "Quality_Score": 0.20, "Performance_Score": 0.16,
        "Total_Energy_kWh": 0.14, "Carbon_kg": 0.12, "Eco_Efficiency_Score": 0.16,
    },
    "Best Yield + Low Energy": {
        "Yield_Percent": 0.36, "Quality_Score": 0.10, "Performance_Score": 0.05,
        "Total_Energy_kWh": 0.21, "Carbon_kg": 0.11, "Eco_Efficiency_Score": 0.17,
    },
    "Best Quality + Best Yield": {
        "Yield_Percent": 0.29, "Quality_Score": 0.34, "Performance_Score": 0.08,
        "Total_Energy_kWh": 0.08, "Carbon_kg": 0.08, "Eco_Efficiency_Score": 0.13,
    },
    "Max Performance + Min Carbon": {
        "Yield_Percent": 0.06, "Quality_Score": 0.08, "Performance_Score": 0.34,
        "Total_Energy_kWh": 0.12, "Carbon_kg": 0.22, "Eco_Efficiency_Score": 0.18,
    },
    "Green Compliance Priority": {
        "Yield_Percent": 0.14, "Quality_Score": 0.10, "Performance_Score": 0.08,
        "Total_Energy_kWh": 0.23, "Carbon_kg": 0.22, "Eco_Efficiency_Score": 0.23,
    },
}

# Strictness -> quantile q for minima; maxima use 1 - q + 0.15.
STRICTNESS_QUANTILE = {"Open": 0.20, "Standard": 0.40, "Strict": 0.55}

REQUIRED_PRODUCTION_COLUMNS = [
    "Batch_ID", "Cycle_Time", "Process_Agent_Amount", "Heat_Temp", "Heat_Duration",
    "Press_Force", "Machine_Speed", "Lubricant_Additive", "Moisture_Level", "Unit_Weight",
    "Strength_Score", "Defect_Rate", "Cycle_Completion_Time", "Output_Quality_Rate",
    "Uniformity_Index",
]

REQUIRED_PROCESS_COLUMNS = [
    "Batch_ID", "Time_Minutes", "Phase", "Temperature_C", "Pressure_Bar", "Humidity_Percent",
    "Motor_Speed_RPM", "Compression_Force_kN", "Flow_Rate_LPM", "Power_Consumption_kW",
    "Vibration_mm_s",
]

# Engine alias table (names are compared after lower-casing and replacing
# every run of non-alphanumerics by "_").
ENGINE_ALIASES = {
    "timestamp": ["timestamp", "time", "datetime", "date_time", "recorded_at"],
    "batch_id": ["batch_id", "batch", "batchid", "lot_id", "lot"],
    "machine_id": ["machine_id", "machine", "line_id", "line", "asset_id", "equipment_id"],
    "operation_mode": ["operation_mode", "mode", "state", "status", "efficiency_status"],
    "temperature_c": ["temperature_c", "temperature", "temp_c", "temp", "avg_temperature", "drying_temp"],
    "pressure_bar": ["pressure_bar", "pressure", "press_bar", "avg_pressure"],
    "humidity_percent": ["humidity_percent", "humidity", "moisture", "relative_humidity"],
    "motor_speed_rpm": ["motor_speed_rpm", "machine_speed", "rpm", "speed", "max_motor_speed_rpm"],
    "compression_force_kn": ["compression_force_kn", "compression_force", "force", "force_kn"],
    "flow_rate_lpm": ["flow_rate_lpm", "flow_rate", "avg_flow_rate_lpm"],
    "power_kw": ["power_consumption_kw", "power_kw", "power", "kw"],
    "energy_kwh": ["energy_kwh", "total_energy_kwh", "consumption_kwh", "kwh", "energy"],
    "quality_score": ["quality_score", "quality", "quality_index"],
    "defect_rate": ["defect_rate", "quality_control_defect_rate", "quality_control_defect_rate_", "packet_loss"],
    "error_rate": ["error_rate", "error_rate_", "error_percent"],
    "output_qty": ["output_qty", "production_speed_units_per_hr", "production_rate", "throughput", "units_per_hr"],
    "process_time_min": ["process_time_min", "duration_minutes", "duration", "cycle_time", "time_min", "time_minutes"],
    "binder_amount": ["binder_amount"],
    "granulation_time": ["granulation_time"],
    "drying_temp": ["drying_temp"],
    "drying_time": ["drying_time"],
    "lubricant_conc": ["lubricant_conc"],
    "moisture_content": ["moisture_content"],
    "tablet_weight": ["tablet_weight"],
    "hardness": ["hardness"],
    "friability": ["friability"],
    "disintegration_time": ["disintegration_time"],
    "dissolution_rate": ["dissolution_rate"],
    "content_uniformity": ["content_uniformity"],
    "vibration_mm_s": ["vibration_mm_s", "vibration_hz", "vibration"],
}

# Standard-schema alias table (names compared after strip, lower, space -> "_").
STANDARD_SCHEMA = [
    "timestamp", "batch_id", "temperature_c", "pressure_bar", "rpm", "energy_kwh",
    "yield_percent", "quality_score", "process_time_min", "carbon_kg",
]
STANDARD_ALIASES = {
    "timestamp": ["timestamp", "time", "datetime", "date_time", "recorded_at"],
    "batch_id": ["batch_id", "batch", "batchid", "lot_id", "lot"],
    "temperature_c": ["temperature_c", "temperature", "temp_c", "temp", "avg_temperature", "drying_temp"],
    "pressure_bar": ["pressure_bar", "pressure", "press_bar", "avg_pressure"],
    "rpm": ["rpm", "motor_speed_rpm", "machine_speed", "speed", "max_motor_speed"],
    "energy_kwh": ["energy_kwh", "total_energy_kwh", "energy", "power_kwh", "power_consumption_kwh"],
    "yield_percent": ["yield_percent", "yield", "yield_pct", "yield_percentage"],
    "quality_score": ["quality_score", "quality", "quality_index"],
    "process_time_min": ["process_time_min", "duration_minutes", "process_time", "time_min", "duration"],
    "carbon_kg": ["carbon_kg", "co2_kg", "carbon", "emission_kg", "co2"],
}

# Operation modes that count as "active" (case-insensitive).
ACTIVE_MODES = ["run", "running", "production", "productive", "active", "on"]

# Cells starting with one of these are prefixed with a quote on CSV export.
FORMULA_PREFIXES = ["=", "+", "-", "@", "\t"]

# Zones. Feature table: right-closed bins (-1,40] Red, (40,70] Yellow, (70,100] Green.
# Candidates: left-closed, >=70 Green, >=40 Yellow, else Red.
ZONE_EDGES = (-1.0, 40.0, 70.0, 100.0)

# Signal defaults used when a whole signal is missing.
SIGNAL_DEFAULTS = {
    "Temperature_C": 85.0,
    "Pressure_Bar": 5.0,
    "Humidity_Percent": 45.0,
    "Compression_Force_kN": 22.0,
    "Flow_Rate_LPM": 10.0,
    "Vibration_mm_s": 1.5,
    "Output_Signal": 50.0,
    "Quality_Score_Row": 55.0,
    "Energy_kWh_Row": 1.0,
}

# Industry / regulatory profiles: (industry, carbon limit kg, energy limit kWh, standard).
# A missing limit falls back to 2.5 kg / 180 kWh.
INDUSTRY_PROFILES = [
    ("Pharmaceutical", 2.5, 180.0, "ISO 14001 / GHG Protocol"),
    ("Automotive", 3.8, 320.0, "IATF 16949 / CDP"),
    ("Food & Beverage", 1.8, 140.0, "ISO 50001 / SBTi"),
    ("Textiles", 4.2, 260.0, "ZDHC / Higg Index"),
    ("Electronics", 1.2, 95.0, "IPC-1401 / RoHS"),
    ("Custom", None, None, "User-defined"),
]
DEFAULT_CARBON_LIMIT = 2.5
DEFAULT_ENERGY_LIMIT = 180.0

# Comparison status labels.
STATUS_MAX_OK = "On/Above Target"
STATUS_MAX_BAD = "Below Target"
STATUS_MIN_OK = "On/Below Target"
STATUS_MIN_BAD = "Above Target"
STATUS_ALIGNED = "Aligned"
STATUS_ADJUST = "Adjust"

# Recommendation texts ({} marks the inserted values).
REC_HEAT_DURATION = "Reduce {key} by ~{minutes} minutes to cut excess energy ({pct}% above golden)."
REC_HEAT_TEMP = "Lower {key} by ~{degrees}\u00b0C to align with golden thermal profile."
REC_SPEED_LOW = "Machine speed is below the golden benchmark \u2014 check for idle/standby states consuming energy without output."
REC_IDLE = "Review non-productive machine states and idle phases \u2014 these often account for 10\u201320% of wasted energy."
REC_QUALITY_GAP = "Quality score is {pct}% below golden benchmark."
REC_AGENT = "Increase {key} toward the golden level \u2014 insufficient process agent is a common cause of quality loss."
REC_FORCE = "Raise {key} toward the golden level \u2014 sub-optimal force reduces product integrity."
REC_MOISTURE = "Moisture level exceeds golden profile \u2014 tighten endpoint control for {key} before next stage."
REC_YIELD_CYCLE = "Yield is {pct}% below golden \u2014 {key} is shorter than the golden profile. Increase it gradually to improve uniformity and output rate."
REC_YIELD_GENERIC = "Yield is {pct}% below golden \u2014 run a parameter comparison against the Golden Signature to isolate root cause."
REC_CARBON = "Carbon footprint is above the golden benchmark \u2014 shift high-load operations to greener energy windows or reduce total energy consumption."
REC_ECO = "Eco-Efficiency Score dropped against the golden benchmark \u2014 prioritize energy reduction and cycle-time correction first."
REC_CLOSE = "Batch is performing close to the Golden Signature. Maintain current settings and continue monitoring for drift."

# Key preference lists used by the recommendation rules.
HEAT_DURATION_KEYS = ["Heat_Duration", "Drying_Time", "Cure_Time", "Cook_Duration"]
HEAT_TEMP_KEYS = ["Heat_Temp", "Drying_Temp", "Cure_Temp", "Cook_Temp"]
AGENT_KEYS = ["Process_Agent_Amount", "Binder_Amount", "Dye_Amount", "Adhesive_Amount"]
FORCE_KEYS = ["Press_Force", "Compression_Force", "Stamp_Force", "Clamp_Force"]
MOISTURE_KEYS = ["Moisture_Level", "Moisture_Content", "Humidity_Percent"]
CYCLE_KEYS = ["Cycle_Time", "Granulation_Time", "Mix_Time", "Process_Time"]

# Benchmark gap sentence parts.
GAP_NO_BASELINE = "No baseline available."
GAP_ON_TARGET = "On target."
GAP_SENTENCE = "{abs_delta}{unit} {direction} ({abs_pct}%) than benchmark, {verdict}."

# Feature-store version tag (part of the input fingerprint).
STORE_VERSION = "batchlens_feature_store_v1"
# KPI report section rows and compliance labels.
REPORT_SECTION_PERFORMANCE = "\u2500\u2500 PERFORMANCE \u2500\u2500"
REPORT_SECTION_COMPLIANCE = "\u2500\u2500 REGULATORY COMPLIANCE \u2500\u2500"
REPORT_SECTION_ROI = "\u2500\u2500 ROI \u2500\u2500"
REPORT_SECTION_RECS = "\u2500\u2500 AI RECOMMENDATIONS \u2500\u2500"
COMPLIANT = "\u2705 COMPLIANT"
NON_COMPLIANT = "\u274c NON-COMPLIANT"
# ------------------------------------------------------------ END FIXED VALUES

# Words that mark a column of a process table.
SNIFF_KEYWORDS = ["time", "timestamp", "minute", "temperature", "motor", "rpm", "pressure", "flow"]

# Baseline values of missing feature columns.
BASELINE_DEFAULTS = {
    "Avg_Temperature": 72.0,
    "Avg_Pressure": 4.3,
    "Avg_Vibration_mm_s": 1.4,
    "Quality_Score": 86.0,
    "Total_Energy_kWh": 170.0,
    "Yield_Percent": 90.0,
    "Carbon_kg": 0.0,
    "Process_Health_Score": 85.0,
    "Eco_Efficiency_Score": 82.0,
    "Performance_Score": 85.0,
}

# Metrics of the analysis views, in order; columns of the batch history.
ANALYSIS_METRICS = [
    "Total_Energy_kWh", "Quality_Score", "Yield_Percent", "Carbon_kg", "Eco_Efficiency_Score",
    "Process_Health_Score", "Avg_Temperature", "Avg_Pressure", "Avg_Vibration_mm_s", "Duration_Minutes",
]
HISTORY_COLUMNS = ["Batch_ID", "Yield_Percent", "Quality_Score", "Total_Energy_kWh", "Carbon_kg", "Eco_Efficiency_Score", "Green_Zone"]
