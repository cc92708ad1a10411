"""Declarative plans: analytic SQL packs, dataset specs and their generation."""
