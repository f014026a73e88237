"""Transcripts and the chunks expected of them: (index, start, end, segments, text length)."""

TRANSCRIPT_A = [
    ("0:00", "Welcome to this video tutorial."),
    ("0:05", "Today we will learn about neural networks."),
    ("0:12", "Neural networks are inspired by the human brain."),
    ("0:20", "They consist of interconnected nodes called neurons."),
    ("0:28", "Each neuron processes information and passes it forward."),
    ("0:36", "Training involves adjusting weights through backpropagation."),
    ("0:45", "This is a fascinating topic!"),
    ("0:50", "Let me explain in more detail."),
    ("0:55", "First, consider the input layer."),
    ("1:02", "It receives the raw data."),
    ("1:08", "Then hidden layers process the information."),
    ("1:15", "Finally, the output layer produces results."),
]
TRANSCRIPT_B = list(
    zip(
        "0:00 0:05 0:15 0:25 0:35 0:45 0:55 1:05 1:15 1:25".split(),
        [
            "Welcome to this tutorial on machine learning fundamentals.",
            "Today we will learn about neural networks and how they work.",
            "Neural networks are computational models inspired by biological neurons.",
            "They consist of layers of interconnected nodes that process information.",
            "The training process uses backpropagation to adjust weights.",
            "Gradient descent is the optimization algorithm that minimizes error.",
            "Deep learning involves neural networks with many hidden layers.",
            "Convolutional neural networks are excellent for image recognition.",
            "Recurrent neural networks handle sequential data like text or time series.",
            "Thank you for watching this introduction to neural networks.",
        ],
    )
)
GOLDEN = {
    ("A", "time", 30, 5): [(0, 0, 30, 5, 233), (1, 25, 55, 5, 230), (2, 50, 78, 5, 177)],
    ("A", "time", 20, 3): [(0, 0, 20, 3, 123), (1, 17, 37, 4, 219), (2, 34, 54, 4, 177), (3, 51, 71, 4, 133), (4, 68, 78, 2, 87)],
    ("A", "sentence", 50, 0): [(0, 0, 8, 2, 74), (1, 12, 23, 2, 101), (2, 28, 31, 1, 56), (3, 36, 39, 1, 60), (4, 45, 53, 2, 59), (5, 55, 65, 2, 58), (6, 68, 78, 2, 87)],
    ("A", "sentence", 100, 0): [(0, 0, 15, 3, 123), (1, 20, 31, 2, 109), (2, 36, 53, 3, 120), (3, 55, 71, 3, 102), (4, 75, 78, 1, 43)],
    ("A", "token", 400, 50): [(0, 0, 78, 12, 501)],
    ("A", "token", 100, 20): [(0, 0, 65, 10, 399), (1, 45, 78, 6, 181)],
    ("B", "time", 30, 5): [(0, 0, 30, 4, 265), (1, 25, 55, 3, 202), (2, 50, 80, 4, 274), (3, 75, 88, 2, 135)],
    ("B", "time", 20, 3): [(0, 0, 20, 3, 192), (1, 17, 37, 3, 206), (2, 34, 54, 3, 202), (3, 51, 71, 3, 199), (4, 68, 88, 3, 202), (5, 85, 88, 1, 60)],
    ("B", "sentence", 100, 0): [(0, 0, 8, 2, 119), (1, 15, 28, 2, 145), (2, 35, 48, 2, 129), (3, 55, 68, 2, 130), (4, 75, 88, 2, 135)],
    ("B", "token", 400, 50): [(0, 0, 88, 10, 662)],
    ("B", "token", 100, 20): [(0, 0, 58, 7, 400), (1, 35, 88, 6, 342), (2, 85, 88, 1, 22)],
}
