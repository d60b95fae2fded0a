"""Thresholds, targets, weights and word lists.

These numbers and words define the results, so they are stated plainly and kept in one place.
"""

HIGHER = "higher_better"
LOWER = "lower_better"

# Benchmark targets: metric -> (target, direction).  Fixed values.
BENCHMARKS = {
    "quality_score": (0.70, HIGHER),
    "mean_ks": (0.20, LOWER),
    "mean_jsd": (0.03, LOWER),
    "max_jsd": (0.10, LOWER),
    "ml_accuracy": (0.70, HIGHER),
    "f1_score": (0.65, HIGHER),
    "auc": (0.75, HIGHER),
    "privacy_score": (0.75, HIGHER),
    "mean_nnd": (0.60, HIGHER),
    "high_risk_pct": (0.02, LOWER),
    "max_column_jsd": (0.10, LOWER),
    "max_amplification_ratio": (1.20, LOWER),
}

# Level cuts: metric -> (excellent, acceptable, warning); beyond the last is Critical.
# Direction as in BENCHMARKS.  Fixed values.
LEVEL_CUTS = {
    "quality_score": (0.80, 0.70, 0.60),
    "privacy_score": (0.85, 0.75, 0.65),
    "mean_ks": (0.10, 0.20, 0.30),
    "mean_jsd": (0.02, 0.03, 0.05),
    "max_jsd": (0.05, 0.10, 0.15),
    "ml_accuracy": (0.80, 0.70, 0.60),
    "f1_score": (0.75, 0.65, 0.55),
    "auc": (0.85, 0.75, 0.65),
    "mean_nnd": (0.70, 0.60, 0.50),
    "high_risk_pct": (0.01, 0.02, 0.05),
}

# Hard limits: metric -> (limit, direction).  Fixed values.
HARD_LIMITS = {
    "privacy_score": (0.75, HIGHER),
    "quality_score": (0.60, HIGHER),
    "ml_accuracy": (0.55, HIGHER),
    "f1_score": (0.50, HIGHER),
    "auc": (0.60, HIGHER),
    "mean_nnd": (0.40, HIGHER),
    "mean_jsd": (0.08, LOWER),
    "max_jsd": (0.20, LOWER),
    "mean_ks": (0.35, LOWER),
    "high_risk_pct": (0.05, LOWER),
    "max_amplification_ratio": (1.50, LOWER),
}

# Which report bucket each metric belongs to.  Fixed values.
BUCKETS = {
    "quality_score": "quality",
    "mean_ks": "quality",
    "mean_jsd": "quality",
    "max_jsd": "quality",
    "ml_accuracy": "utility",
    "f1_score": "utility",
    "auc": "utility",
    "privacy_score": "privacy",
    "mean_nnd": "privacy",
    "high_risk_pct": "privacy",
    "max_column_jsd": "bias",
    "max_amplification_ratio": "bias",
}

LEVELS = ("Critical", "Warning", "Acceptable", "Excellent")  # rank 0..3
IMPACTS = ("Critical", "High", "Medium", "Low")  # rank 0..3

# Table-size cuts (rows).  Fixed values.
SIZE_CRITICAL, SIZE_SMALL, SIZE_MEDIUM = 500, 1000, 5000

# Diversity bounds.  Fixed values.
MIN_UNIQUE_RATIO, CRITICAL_UNIQUE_RATIO = 0.95, 0.80
MAX_DUPLICATE_RATE = 0.02
MIN_ENTROPY_RATIO, MAX_ENTROPY_RATIO = 0.90, 1.10

# Composite score weights.  Fixed values.
COMPOSITE_WEIGHTS = {"quality": 0.30, "utility": 0.30, "privacy": 0.25, "bias": 0.15}

# Expected change per applied recommendation, by category.  Fixed values.
CATEGORY_GAINS = [
    ("preprocessing", "quality_score", 0.05),
    ("preprocessing", "mean_jsd", -0.01),
    ("model", "quality_score", 0.10),
    ("training", "quality_score", 0.05),
    ("training", "ml_accuracy", 0.05),
    ("post_processing", "privacy_score", 0.05),
]
CATEGORY_ORDER = ("post_processing", "preprocessing", "training", "model", "data_strategy")

# Record schema of the genomic sample table, and the values each field may take.  Fixed values.
GENES = ["CFTR", "DMD", "HBB", "F8", "HEXA"]
CHROMOSOMES = ["chr7", "chrX", "chr11", "chrX", "chr15"]
VARIANT_TYPES = ["SNV", "Insertion", "Deletion", "Duplication"]
SIGNIFICANCES = ["Pathogenic", "Likely Pathogenic", "VUS", "Benign"]
DISEASES = ["Cystic Fibrosis", "Duchenne Muscular Dystrophy", "Sickle Cell Disease"]
INHERITANCE_PATTERNS = ["Autosomal Dominant", "Autosomal Recessive", "X-linked"]
VARIANT_FIELDS = [
    "gene_symbol", "chromosome", "variant_type", "clinical_significance",
    "disease", "allele_frequency", "inheritance_pattern",
]

# Wider word lists accepted by the constraint rules.  Fixed values.
CONSTRAINT_VARIANT_TYPES = [
    "Missense", "Nonsense", "Frameshift", "Splice Site", "Deletion", "Insertion",
    "Duplication", "SNV", "CNV", "Indel", "",
]
CONSTRAINT_SIGNIFICANCES = [
    "Pathogenic", "Likely Pathogenic", "Benign", "Likely Benign",
    "Uncertain Significance", "VUS", "",
]
