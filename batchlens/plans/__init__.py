from batchlens.plans.curate import curate, focus_slice
from batchlens.plans.clean import clean
from batchlens.plans.detect import explain_outliers, fence_screen, final_model

__all__ = ["clean", "curate", "explain_outliers", "fence_screen", "final_model", "focus_slice"]
