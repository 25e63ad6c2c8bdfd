"""Fixed values. They must equal the published rules for results to agree."""

# Ordered levels.
DIFFICULTIES = ["beginner", "intermediate", "advanced"]
ENERGIES = ["low", "medium", "high"]
ROLES = ["lead_focus", "follow_focus", "both"]

# Item labels in the catalogue.
LABELS = [
    "basic_step", "cross_body_lead", "lady_right_turn", "lady_left_turn", "dip",
    "forward_backward", "body_roll", "hammerlock", "shadow_position", "combination",
    "arm_styling", "double_cross_body_lead",
]

# Category by substring of the label, first match wins.
CATEGORY_RULES = [
    ("basic_step", "basic_step"), ("cross_body_lead", "cross_body_lead"),
    ("lady_right_turn", "lady_right_turn"), ("lady_left_turn", "lady_left_turn"),
    ("dip", "dips"), ("forward_backward", "forward_backward"), ("body_roll", "body_roll"),
    ("hammerlock", "hammerlock"), ("shadow_position", "shadow_position"),
    ("combination", "combination"), ("arm_styling", "arm_styling"),
]

# Type by substring of the label, first match wins, else "other".
TYPE_RULES = [
    ("basic", "basic"), ("turn", "turn"), ("cross", "cross_body"), ("dip", "dip"),
    ("roll", "body_roll"), ("styling", "styling"), ("arm", "styling"),
    ("shadow", "shadow"), ("hammerlock", "hammerlock"),
]

# Types a request may name.
REQUEST_TYPES = [
    "basic_step", "cross_body_lead", "lady_right_turn", "lady_left_turn",
    "forward_backward", "dips", "body_roll", "hammerlock", "shadow_position",
    "combination", "arm_styling", "double_cross_body_lead",
]

# Labels that make a beginner mark suspicious, and labels of complex or rhythmic items.
ADVANCED_LABELS = ["body_roll", "hammerlock", "shadow_position", "combination", "arm_styling"]
COMPLEX_LABELS = ["combination", "body_roll", "hammerlock", "shadow_position"]
RHYTHMIC_LABELS = ["basic_step", "forward_backward", "cross_body_lead"]

# Similarity of two different labels; 0.1 where no entry holds, 1 for equal labels.
LABEL_SIMILARITY = [
    ("basic_step", "combination_basic_step", 0.8),
    ("basic_step", "forward_backward", 0.6),
    ("lady_right_turn", "lady_left_turn", 0.7),
    ("cross_body_lead", "double_cross_body_lead", 0.8),
    ("body_roll", "arm_styling", 0.4),
    ("hammerlock", "shadow_position", 0.3),
    ("dip", "shadow_position", 0.3),
    ("combination", "cross_body_lead", 0.4),
    ("combination", "lady_right_turn", 0.4),
    ("combination", "body_roll", 0.4),
]

# Directed relation used by the rule-based truth of a pair.
RELATED_LABELS = [
    ("basic_step", "forward_backward"), ("cross_body_lead", "double_cross_body_lead"),
    ("lady_right_turn", "lady_left_turn"), ("body_roll", "arm_styling"),
]

# Catalogue limits.
MIN_TEMPO, MAX_TEMPO = 80, 160
MIN_CLIP_SECONDS, MAX_CLIP_SECONDS = 3.0, 20.0

# Score weights.
SCORE_WEIGHTS = {"audio": 0.4, "tempo": 0.3, "energy": 0.2, "difficulty": 0.1}
SPACE_WEIGHTS = {
    "text": 0.3, "tempo": 0.25, "difficulty": 0.15,
    "energy": 0.15, "role": 0.1, "transition": 0.05,
}
TEMPO_SEARCH_WEIGHTS = {
    "text": 0.1, "tempo": 0.7, "difficulty": 0.1,
    "energy": 0.05, "role": 0.05, "transition": 0.0,
}
CATEGORICAL_SEARCH_WEIGHTS = {
    "text": 0.2, "tempo": 0.3, "difficulty": 0.2,
    "energy": 0.25, "role": 0.15, "transition": 0.1,
}
TRANSITION_WEIGHTS = {"pose": 0.25, "flow": 0.35, "energy": 0.25, "difficulty": 0.15}
QUALITY_WEIGHTS = {
    "flow": 0.25, "musicality": 0.25, "progression": 0.15,
    "diversity": 0.20, "smoothness": 0.15,
}

# Dimensions of the spaces of the unified vector.
TEXT_DIM, NUMBER_DIM, LEVEL_DIM, TRANSITION_DIM = 384, 8, 3, 64
TEMPO_SPAN = (90.0, 150.0)
DIFFICULTY_SPAN = (1.0, 3.0)
TRANSITION_SEEDS = [1, 7, 13]

# Style presets: tempo tolerance, diversity, transition weight.
STYLE_PRESETS = {
    "balanced": (10.0, 0.3, 0.4),
    "energetic": (15.0, 0.5, 0.3),
    "smooth": (8.0, 0.2, 0.6),
    "technical": (5.0, 0.4, 0.5),
}
STYLE_PHRASES = {
    "energetic": "dynamic and expressive", "smooth": "flowing and connected",
    "technical": "precise and complex", "balanced": "well-rounded",
}

# Genre named in descriptions and advice.
GENRE = "bachata"

# Words of the request text.
REQUEST_DIFFICULTY = [
    ("beginner", ["beginner", "basic", "easy"]),
    ("advanced", ["advanced", "complex", "difficult"]),
    ("intermediate", ["intermediate", "medium"]),
]
REQUEST_ENERGY = [
    ("high", ["energetic", "high energy", "fast", "dynamic"]),
    ("low", ["calm", "low energy", "slow", "gentle"]),
    ("medium", ["medium", "moderate", "balanced"]),
    ("medium", ["smooth", "flowing"]),
]
REQUEST_TYPE_WORDS = [
    ("basic", ["basic", "step", "foundation"]),
    ("turn", ["turn", "spin", "rotation"]),
    ("cross_body", ["cross", "body", "lead"]),
    ("styling", ["styling", "arm", "hand"]),
    ("dip", ["dip", "lean"]),
    ("footwork", ["footwork", "feet", "step"]),
]
REQUEST_WEIGHT_WORDS = [
    ("musical", ["musical", "rhythm", "beat"]),
    ("tempo", ["tempo", "bpm", "speed"]),
    ("flow", ["flow", "transition", "sequence"]),
]

# Landmark groups of a pose (33 points).
REGIONS = {
    "upper_body": [11, 12, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
    "lower_body": [23, 24, 25, 26, 27, 28, 29, 30, 31, 32],
    "arms": [11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22],
    "legs": [23, 24, 25, 26, 27, 28, 29, 30, 31, 32],
}
BODY_PARTS = {
    "left_arm": [11, 13, 15], "right_arm": [12, 14, 16],
    "left_leg": [23, 25, 27], "right_leg": [24, 26, 28],
    "torso": [11, 12, 23, 24],
}
FEATURE_REGIONS = {
    "head": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
    "torso": [11, 12, 23, 24],
    "left_arm": [11, 13, 15, 17, 19, 21],
    "right_arm": [12, 14, 16, 18, 20, 22],
    "left_leg": [23, 25, 27, 29, 31],
    "right_leg": [24, 26, 28, 30, 32],
}
JOINTS = {
    "left_elbow": (11, 13, 15), "right_elbow": (12, 14, 16),
    "left_knee": (23, 25, 27), "right_knee": (24, 26, 28),
}
CENTRE_POINTS = [11, 12, 23, 24, 25, 26]
FOOT_POINTS = [27, 28, 31, 32]
FIFTHS = [0, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10, 5]

# Stored filter templates: name, difficulty, energy, role, tempo range, labels; None is a wildcard.
TEMPLATES = [
    ("beginner", "beginner", None, None, None, None),
    ("advanced_high", "advanced", "high", None, None, None),
    ("slow", None, "low", None, (102, 115), None),
    ("lead", None, None, "lead_focus", None, None),
    ("follow", None, None, "follow_focus", None, None),
    ("fast", None, None, None, (135, 150), None),
    ("balanced", "intermediate", "medium", None, None, None),
    ("turns", None, None, None, None, ("lady_right_turn", "lady_left_turn")),
]

# Target group of each label in the catalogue's folders; other labels go to advanced.
GROUPS = {
    "basic_step": "basic_moves", "cross_body_lead": "partner_work", "double_cross_body_lead": "partner_work",
    "lady_right_turn": "turns_spins", "lady_left_turn": "turns_spins", "forward_backward": "basic_moves",
    "dip": "advanced", "body_roll": "styling", "hammerlock": "advanced", "shadow_position": "advanced",
    "combination": "advanced", "arm_styling": "styling",
}
