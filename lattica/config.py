"""Fixed values that define results. They are shared by operators, queries and tests."""

LEARNING_RATE, WEIGHT_CAP, PRUNE_THRESHOLD = 0.30, 1.0, 0.01
LTP_THRESHOLD, LTP_FLOOR = 5, 0.20
HUB_DEGREE, SPREAD_DECAY, SPREAD_DEPTH, SPREAD_TOP_K = 50, 0.6, 2, 12
TRANSITION_RATE, TRANSITION_CAP, TRANSITION_PRUNE, NEXT_TOP_K = 1.0, 100.0, 0.5, 5
NAMESPACE_FACTORS = {"branch": 1.0, "personal": 0.8, "shared": 0.5}
HALF_LIFE_DAYS, HALF_LIFE_SHARED, HALF_LIFE_EPHEMERAL = 30.0, 60.0, 1.0
SEED_BASE, SEED_LOG, SEED_MAX = 0.25, 0.06, 0.70
RRF_K, CHARS_PER_TOKEN = 60, 4
LAYER_TOKENS = {"L0": 150, "L1": 600, "L2": 800, "L3": 1000}
SYNAPSE_SEEDS, SYNAPSE_BOOST, PULL_IN_MAX, PULL_IN_ENERGY = 3, 0.3, 2, 0.15
STRUCTURAL_BOOST = 0.35
BM25_K1, BM25_B = 1.5, 0.75
SPLADE_TOP, SPLADE_KEEP, SPLADE_SPREAD = 30, 50, 0.1
VIEW_WEIGHTS = {"callers": 1.0, "callees": 0.9, "bases": 0.8, "subclasses": 0.7, "importers": 0.5}
GAP_THRESHOLD = 0.005
RELATION_WEIGHTS = {"calls": 1.0, "inherits": 0.9, "imports": 0.8, "imports_from": 0.8, "contains": 0.3, "rationale_for": 0.2}
OTHER_RELATION_WEIGHT = 0.5
COHESION, MIN_PEERS, MAX_FINDINGS, MAX_DRIFT = 0.6, 3, 5, 10
W_REINFORCEMENT, W_RECENCY, W_CONFLICT = 0.4, 0.35, 0.25
QUALITY_HIGH, QUALITY_LOW = 0.7, 0.3
AUTO_PROMOTE, REJECT = 0.70, 0.15
CONTEST_BELOW, CONTEST_GAP = 0.3, 0.05
ENTITY_MERGE, ENTITY_REVIEW = 0.95, 0.85
STALE_DAYS = {"shared": 30, "branch": 14, "other": 60}
FAST_DECAY = 5.0
LEARNED_MIN_DAYS, LEARNED_MAX_DAYS = 3.0, 120.0
BASELINE_TOKENS = 50_000
CHUNK_SIZE, CHUNK_OVERLAP = 500, 50
FITNESS_WEIGHTS, HYSTERESIS = (0.5, 0.3, 0.2), 0.05
QUALITY_FLOORS = {"mrr": 0.5, "answerability": 0.7, "recall_at_5": 0.5, "ndcg_at_5": 0.5, "hit_at_5": 0.8}
DAY = 86_400.0
LN2 = 0.6931471805599453
