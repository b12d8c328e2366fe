"""Schemas of run documents and of the motion tables."""

from __future__ import annotations

RUN_SCHEMA_VERSION = "motion.run.v1"
ANALYSIS_SCHEMA_VERSION = "motion.analysis.v1"

SUBJECT = "struct<index int, id string, label string, color string, track_file string>"
RUN_DOC = (
    "run_id string, video_input string, source_video string, fps_output double, fps double, "
    "video_width int, video_height int, inference_target string, total_frames_processed int, "
    f"created_at string, updated_at string, subject {SUBJECT}, "
    "camera_motion_compensation struct<shift_px_step_mean_small double>, records array<string>"
)
RECORD = (
    "frame_index int, video_frame int, mesh_path string, subject_present boolean, "
    "inference_status string, subject_tracking_status string, identity_lock_status string, "
    "identity_is_lost boolean, identity_lost_frames int, identity_appearance_similarity double, "
    "identity_gallery_similarity double, identity_stability_score double, focal_length double, "
    "bbox_xyxy array<double>, camera_comp_cam_xyz array<double>, "
    "joints_cam_xyz array<array<double>>, joints_space_cam_xyz array<array<double>>"
)
DETECTION_LINE = "f long, t double, dets array<struct<id long, b array<double>, s double>>"
ANALYSIS_ENTRY = "struct<analysis_id string, preset string, created_at string, qa_status string>"
