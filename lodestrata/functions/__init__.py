"""Column expressions and their numpy twins: weights, distances, geometries, uniforms."""
