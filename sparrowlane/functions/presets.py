"""Named parameter presets by family."""

from __future__ import annotations

# fixed values: families of presets, their names, and the parameters of those that operators here take
PRESETS: dict[str, dict[str, dict[str, float | str]]] = {
    "chelation": {"conservative": {"chelation_p": 95, "chelation_threshold": 0.01}, "balanced": {"chelation_p": 85, "chelation_threshold": 0.01}, "aggressive": {"chelation_p": 75, "chelation_threshold": 0.0004}},
    "adapter": {"small": {}, "medium": {}, "large": {}},
    "rlm": {"balanced": {"max_depth": 3, "min_support": 5}, "shallow": {"max_depth": 2, "min_support": 10}, "deep": {"max_depth": 5, "min_support": 2}},
    "sedimentation": {"balanced": {"collapse_threshold": 3, "push_magnitude": 0.1}, "conservative": {"collapse_threshold": 5, "push_magnitude": 0.05}, "aggressive": {"collapse_threshold": 1, "push_magnitude": 0.2}},
    "sedimentation_tuned": {"conservative": {"learning_rate": 0.001, "threshold": 1, "noise_scale": 0.05, "epochs": 5}, "balanced": {"learning_rate": 0.01, "threshold": 1, "noise_scale": 0.1, "epochs": 5}, "aggressive": {"learning_rate": 0.01, "threshold": 1, "noise_scale": 0.2, "epochs": 10}},
    "convergence": {"patient": {"patience": 10, "rel_threshold": 0.0005, "min_epochs": 5}, "balanced": {"patience": 5, "rel_threshold": 0.001, "min_epochs": 3}, "aggressive": {"patience": 2, "rel_threshold": 0.005, "min_epochs": 2}},
    "adapter_type": {"mlp": {}, "procrustes": {}, "low_rank": {}},
    "ensemble": {"diverse": {}, "multilingual": {}},
    "cross_lingual": {"en_de": {}, "en_zh": {}, "en_ja": {}, "multilingual_universal": {}, "multilingual_hybrid": {}},
    "teacher_weight_schedule": {"constant": {}, "gradual_decay": {}, "cosine": {}, "aggressive_decay": {}, "adaptive": {}},
    "teacher_encoding": {"default": {}, "large_corpus": {}, "memory_constrained": {}, "gpu_optimized": {}},
    "online_update": {"conservative": {}, "balanced": {}, "aggressive": {}},
    "beir": {"quick": {}, "small": {}, "medium": {}, "research": {}, "full": {}},
    "topology": {"tight": {"covalent_threshold": 0.95, "hydrogen_threshold": 0.80, "vdw_threshold": 0.50}, "balanced": {"covalent_threshold": 0.90, "hydrogen_threshold": 0.70, "vdw_threshold": 0.40}, "loose": {"covalent_threshold": 0.85, "hydrogen_threshold": 0.60, "vdw_threshold": 0.30}},
    "isomer": {"sensitive": {"strength_threshold": 0.1, "top_k": 10}, "balanced": {"strength_threshold": 0.3, "top_k": 10}, "strict": {"strength_threshold": 0.5, "top_k": 10}},
    "bounded_adapter": {"conservative": {"min_correction": 0.01, "max_correction": 0.3}, "balanced": {"min_correction": 0.01, "max_correction": 0.5}, "aggressive": {"min_correction": 0.02, "max_correction": 0.8}},
    "sedimentation_loss": {"mse": {"loss_type": "mse"}, "contrastive": {"loss_type": "infonce", "temperature": 0.07}, "hybrid": {"loss_type": "hybrid", "contrastive_weight": 0.5, "mse_weight": 0.5, "temperature": 0.07}},
    "kalman_lr": {"conservative": {"process_noise": 0.05, "min_lr_ratio": 0.1, "max_lr_ratio": 1.5, "window_size": 10}, "balanced": {"process_noise": 0.1, "min_lr_ratio": 0.1, "max_lr_ratio": 2.0, "window_size": 10}, "aggressive": {"process_noise": 0.2, "min_lr_ratio": 0.2, "max_lr_ratio": 3.0, "window_size": 10}},
    "es_optimizer": {"conservative": {}, "balanced": {}, "aggressive": {}},
}


def preset(name: str, family: str = "chelation") -> dict[str, float | str]:
    """A copy of the parameters; an unknown family or name is an error that lists what there is."""
    if family not in PRESETS:
        raise ValueError(f"unknown family {family}: there are {', '.join(PRESETS)}")
    if name not in PRESETS[family]:
        raise ValueError(f"unknown preset {name}: there are {', '.join(PRESETS[family])}")
    return dict(PRESETS[family][name])
