"""Random forests next to the rules: training, scoring, explanation and evaluation."""
