"""Privacy analytics on Spark: personal-data detection, policy, gating, fusion and scoring as DataFrame plans."""
