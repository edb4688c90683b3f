"""Engine parameters.

Fixed values below must equal the detection system's configuration so that
decisions come out the same; they are stated once, in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must match the reference configuration)
# ---------------------------------------------------------------------------
ATTACK_TYPES = [
    "DoS", "DDoS", "Botnet", "Brute_Force", "Spoofing",
    "Probing", "Injection", "Data_Theft", "Benign",
]
MODEL_TYPES = ["lstm", "svm"]
ENSEMBLE_WEIGHTS = {"lstm": 0.6, "svm": 0.4}
DEFAULT_MODEL_WEIGHT = 0.5
CONFIDENCE_THRESHOLD = 0.7
CONFLICT_RESOLUTION = "weighted_voting"
# Classes the decision maps to themselves; anything else becomes "Unknown".
KNOWN_CLASSES = [
    "Benign", "DoS", "DDoS", "Botnet", "Brute_Force", "Spoofing",
    "Probing", "Injection", "Data_Theft", "Unknown", "Error",
]
WINDOW_SIZE = 10
WINDOW_OVERLAP = 0.5
CORRELATION_THRESHOLD = 0.95
MAX_FEATURES = 50
MINMAX_RANGE = (0.0, 1.0)
ALERT_THRESHOLDS = {"cpu_usage": 80.0, "memory_usage": 85.0, "disk_usage": 90.0}
HEALTH_CHECK_INTERVAL = "30 seconds"
SCRAPE_INTERVAL = "10 seconds"
TRAIN_BENIGN_CAP = 10000
EVAL_BENIGN_CAP = 5000
SEED = 42
SEVERITIES = ["Low", "Medium", "High", "Critical"]
# Default latency buckets (seconds) of the usual metrics client library.
HISTOGRAM_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0,
                     2.5, 5.0, 7.5, 10.0]
# Dataset registry: label column and declared classes per dataset.
DATASETS = {
    "cic_ids_2018": {
        "files": ["Friday-02-03-2018_TrafficForML_CICFlowMeter.csv"],
        "label_column": "Label",
        "attack_types": ["Benign", "DDoS", "DoS", "Botnet", "Brute Force", "Infiltration"],
    },
    "bot_iot_2019": {
        "files": ["UNSW_2018_IoT_Botnet_Dataset_*.csv"],
        "label_column": "category",
        "attack_types": ["Benign", "DDoS", "DoS", "Reconnaissance", "Theft", "Keylogging"],
    },
    "cic_iot_2023": {
        "files": ["*.csv"],
        "label_column": "Label",
        "attack_types": ["Benign", "DDoS", "DoS", "Mirai", "Gafgyt", "CICMalDroid"],
    },
}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class EnsembleConfig:
    weights: dict = field(default_factory=lambda: dict(ENSEMBLE_WEIGHTS))
    default_weight: float = DEFAULT_MODEL_WEIGHT
    confidence_threshold: float = CONFIDENCE_THRESHOLD
    strategy: str = CONFLICT_RESOLUTION
    known_classes: tuple = tuple(KNOWN_CLASSES)

    def normalized_weights(self) -> dict:
        """Weights rescaled to sum 1 when they are off by more than 0.01."""
        total = sum(self.weights.values())
        if abs(total - 1.0) > 0.01 and total != 0:
            return {k: v / total for k, v in self.weights.items()}
        return dict(self.weights)


def detector_registry() -> list[tuple[int, int, str, str, str]]:
    """(ordinal, attack_idx, cluster_id, attack_type, model_type), attack-major."""
    rows = []
    for a_idx, attack in enumerate(ATTACK_TYPES):
        for m_idx, model in enumerate(MODEL_TYPES):
            rows.append((a_idx * len(MODEL_TYPES) + m_idx, a_idx, f"{attack}_{model}", attack, model))
    return rows
