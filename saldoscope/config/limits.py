"""Thresholds per account type, module weights and score ladders.

Fixed values: they decide which rows are reported, so they are stated as they are.
"""

ACCOUNT_TYPES = [
    "salary_employee", "business_owner", "freelancer", "trader",
    "pensioner", "student", "unknown",
]

# limit -> one value per entry of ACCOUNT_TYPES
TYPE_LIMITS = {
    "burst_rows": [15, 25, 17, 20, 10, 12, 15],
    "outflow_share": [0.5, 2.0, 0.8, 1.5, 0.4, 0.6, 0.7],
    "bidirectional_hub": [8, 50, 10, 20, 6, 6, 8],
    "volatile_cv": [0.6, 1.2, 0.9, 1.0, 0.3, 0.7, 0.7],
    "single_cap": [1000000, 50000000, 3000000, 20000000, 300000, 200000, 2000000],
}

BASE_WEIGHTS = {
    "velocity": 0.15,
    "graph": 0.12,
    "behavioral": 0.00,
    "structuring": 0.18,
    "cross_reference": 0.08,
    "merchant_risk": 0.15,
    "pattern_detector": 0.12,
    "night_transactions": 0.05,
    "duplicate_payments": 0.03,
    "round_amounts": 0.03,
    "profile_mismatch": 0.09,
}

# account type -> multiplier of each module's weight
WEIGHT_MULTIPLIERS = {
    "salary_employee": {
        "velocity": 1.0, "graph": 1.0, "behavioral": 0.0, "structuring": 1.0, "cross_reference": 1.0, "merchant_risk": 1.0,
        "pattern_detector": 1.0, "night_transactions": 1.0, "duplicate_payments": 1.0, "round_amounts": 1.0, "profile_mismatch": 1.0,
    },
    "business_owner": {
        "velocity": 0.5, "graph": 0.3, "behavioral": 0.0, "structuring": 0.8, "cross_reference": 0.4, "merchant_risk": 0.8,
        "pattern_detector": 1.0, "night_transactions": 0.3, "duplicate_payments": 0.8, "round_amounts": 0.4, "profile_mismatch": 0.5,
    },
    "freelancer": {
        "velocity": 0.7, "graph": 0.8, "behavioral": 0.0, "structuring": 0.9, "cross_reference": 0.6, "merchant_risk": 0.9,
        "pattern_detector": 1.0, "night_transactions": 0.6, "duplicate_payments": 0.9, "round_amounts": 0.7, "profile_mismatch": 0.7,
    },
    "trader": {
        "velocity": 0.5, "graph": 0.7, "behavioral": 0.0, "structuring": 0.7, "cross_reference": 0.6, "merchant_risk": 0.2,
        "pattern_detector": 1.0, "night_transactions": 0.2, "duplicate_payments": 0.6, "round_amounts": 0.3, "profile_mismatch": 0.4,
    },
    "pensioner": {
        "velocity": 1.0, "graph": 1.0, "behavioral": 0.0, "structuring": 1.0, "cross_reference": 1.0, "merchant_risk": 1.0,
        "pattern_detector": 1.0, "night_transactions": 1.2, "duplicate_payments": 1.0, "round_amounts": 1.0, "profile_mismatch": 1.2,
    },
    "student": {
        "velocity": 0.9, "graph": 0.9, "behavioral": 0.0, "structuring": 0.9, "cross_reference": 0.9, "merchant_risk": 0.9,
        "pattern_detector": 1.0, "night_transactions": 0.5, "duplicate_payments": 0.9, "round_amounts": 0.8, "profile_mismatch": 1.0,
    },
    "unknown": {
        "velocity": 1.0, "graph": 1.0, "behavioral": 0.0, "structuring": 1.0, "cross_reference": 1.0, "merchant_risk": 1.0,
        "pattern_detector": 1.0, "night_transactions": 1.0, "duplicate_payments": 1.0, "round_amounts": 1.0, "profile_mismatch": 1.0,
    },
}

REPORTING_THRESHOLD = 1000000  # sum that must be reported by law
OUTFLOW_FLOOR = 100000
SIGNIFICANT_FLOOR = 100000
DUPLICATE_FLOOR = 50000
ROUND_FLOOR = 50000
NIGHT_FLOOR = 200000
PASS_THROUGH_FLOOR = 200000
LAYERING_FLOOR = 500000


def effective_weights():
    """Weight per (account type, module): base times multiplier, scaled to sum to one."""
    rows = []
    for kind in ACCOUNT_TYPES:
        raw = {m: BASE_WEIGHTS[m] * WEIGHT_MULTIPLIERS[kind][m] for m in BASE_WEIGHTS}
        total = sum(raw.values())
        rows += [(kind, m, w / total) for m, w in raw.items()]
    return rows
