"""What the pipeline's Python workers are left with: its executors passed 3,000 MB on the last of several inputs."""

import inspect

import corpus_pipeline
from redline.llm import quality_model, token_output


def test_encoder_goes_with_its_task():
    from redline.llm.queries import tokenizer_path

    path = tokenizer_path()
    first = token_output.PieceEncoder.of_worker(path, 10, keep=False)
    assert token_output.PieceEncoder.of_worker(path, 10, keep=False) is not first
    assert token_output.PieceEncoder.of_worker(path, 10) is token_output.PieceEncoder.of_worker(path, 10)
    assert "keep_encoder=False" in inspect.getsource(corpus_pipeline.token_files)


def test_training_needs_no_pandas():
    """It stayed in every worker that trained, for all stages after."""
    assert not hasattr(quality_model, "pd") and "applyInPandas" not in inspect.getsource(quality_model)
