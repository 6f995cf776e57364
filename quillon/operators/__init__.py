"""Labels, evaluation methods, neutralization, screening, blending and maintenance of panels."""
