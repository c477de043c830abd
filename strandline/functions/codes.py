"""Code table of the six-attribute regime strategy."""

from __future__ import annotations

# fixed values: (action, confidence) of codes 1 to 64; results depend on them
CODE_ACTIONS = {
    1: (1.0, 0.95), 2: (-1.0, 0.9), 3: (0.2, 0.6), 4: (0.0, 0.4), 5: (0.3, 0.65), 6: (-0.7, 0.75), 7: (0.5, 0.8), 8: (0.4, 0.7),
    9: (0.25, 0.6), 10: (-0.3, 0.65), 11: (0.8, 0.85), 12: (-0.8, 0.8), 13: (0.6, 0.75), 14: (0.9, 0.9), 15: (0.1, 0.55), 16: (0.7, 0.8),
    17: (0.65, 0.78), 18: (-0.6, 0.7), 19: (0.4, 0.65), 20: (0.0, 0.5), 21: (0.55, 0.72), 22: (0.3, 0.6), 23: (-0.85, 0.88), 24: (0.75, 0.82),
    25: (0.15, 0.58), 26: (0.5, 0.7), 27: (0.7, 0.85), 28: (-0.9, 0.9), 29: (-0.6, 0.75), 30: (0.8, 0.85), 31: (0.45, 0.68), 32: (0.6, 0.75),
    33: (-0.7, 0.8), 34: (0.85, 0.88), 35: (0.65, 0.78), 36: (-0.75, 0.82), 37: (0.2, 0.55), 38: (-0.5, 0.65), 39: (-0.4, 0.6), 40: (0.75, 0.83),
    41: (-0.6, 0.72), 42: (0.8, 0.85), 43: (0.9, 0.9), 44: (0.25, 0.58), 45: (0.5, 0.7), 46: (0.7, 0.8), 47: (-0.85, 0.87), 48: (0.3, 0.62),
    49: (0.6, 0.75), 50: (0.4, 0.65), 51: (0.9, 0.92), 52: (-0.3, 0.6), 53: (0.55, 0.73), 54: (0.1, 0.52), 55: (0.85, 0.89), 56: (0.0, 0.45),
    57: (0.65, 0.77), 58: (0.35, 0.63), 59: (-0.55, 0.68), 60: (-0.2, 0.55), 61: (0.45, 0.67), 62: (0.15, 0.53), 63: (-0.4, 0.65), 64: (0.5, 0.72),
}

#: As a lookup table for ``align.lookup``; add name, regime, element or comment columns as needed.
CODE_TABLE = {k: {"action": a, "confidence": c} for k, (a, c) in CODE_ACTIONS.items()}
CODE_DEFAULTS = {"action": 0.0, "confidence": 0.5}
